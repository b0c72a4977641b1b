import hashlib
import random
import re
import time

from semlake.llm import pii
from tests.llm import helpers

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            if kind == "card":
                total = 0
                for i, c in enumerate(reversed(digits)):
                    v = int(c) * (1 + i % 2)
                    total += v - 9 if v > 9 else v
                if not 14 <= len(digits) <= 19 or total % 10:
                    continue
            out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], list(PATTERNS).index(s[2])))


def test_base_spans_equal_the_plain_patterns():
    rnd = random.Random(7)
    for i in range(20_000):
        text = "".join(rnd.choice("12307.. -+()@@ab._%é" if i % 2 else "0123456789 -") for _ in range(rnd.randint(0, 40)))
        assert pii.base_spans(text) == brute(text), text


def test_linear_on_hostile_texts():
    for text in ("1" * 50_000, "1." * 30_000, "a@" * 30_000, "a." * 30_000 + "@b.c", "+1" * 30_000, "1-" * 30_000):
        pii.scored_spans(text, pii.base_spans(text))


def test_checksums_and_context():
    assert pii.luhn("4242424242424242") and not pii.luhn("4242424242424241")
    assert pii.mod97("GB82 WEST 1234 5698 7654 32") and not pii.mod97("GB82 WEST 1234 5698 7654 33")
    text = "pay to GB82 WEST 1234 5698 7654 32 now"
    assert [s[2] for s in pii.scored_spans(text, pii.base_spans(text))] == ["iban"]
    # Without a word nearby the number is not reported; with one it is.
    for text, want in (("number 078-05-1120 here", []), ("her social security number 078-05-1120", ["ssn"]), ("call me, tel 555-123-4567", ["local_phone"]), ("code 555-123-4567", [])):
        assert [s[2] for s in pii.scored_spans(text, pii.base_spans(text))] == want


def test_ibans_end_where_their_country_says():
    a, b, c = "DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"
    for one in (a, b, c):
        for tail in (" Please pay", " BIC COBADEFF", " 2024 x", " X", ", thanks", "", "\nBIC", " é"):
            text = f"IBAN {one}{tail}"
            assert [s[:3] for s in pii.scored_spans(text, pii.base_spans(text))] == [(5, 5 + len(one), "iban")], text
        for text in (f"IBAN {one}X", f"IBAN {one}0", f"IBAN x{one}", f"IBAN {one[:-1]}", f"IBAN {one[:-2]}  {one[-2:]}"):
            assert not list(pii.ibans(text)), text
    assert list(pii.ibans(f"{a} {b} {c}")) == [(0, 27), (28, 50), (51, 78)]
    assert list(pii.ibans(f"DE44 {c}")) == [(5, 32)] and not list(pii.ibans("ZZ89370400440532013000"))


def test_secrets_by_entropy_and_context():
    hexes = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda"
    for text, want in (
        (f'the token = "{hexes}" here', ["secret"]), (f"commit {hexes} here", []), ("api key: aaaaaaaaaaaaaaaa1111", []), ("password thisisalongwordwithoutdigits", []),
        ("password 12345678901234567", []), ("auth AbC9dEf8GhI7jKl6", ["secret"]), (f"secret {hexes[:15]}", []), ("token " + "a1B2" * 65, []), (f"{hexes} is the token", ["secret"]),
    ):
        assert [s[2] for s in pii.scored_spans(text, pii.base_spans(text))] == want, text


def test_secrets_of_any_length():
    rnd = random.Random(5)
    code = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_-") for _ in range(n))
    for secret in (code(264), code(70_000), f"{code(36)}.{code(310)}.{code(43)}"):
        text = f"the api key = {secret}, keep it"
        assert [s[:3] for s in pii.scored_spans(text, pii.base_spans(text))] == [(14, 14 + len(secret), "secret")]
    head = code(40)
    text = f"token {head}. The end"
    assert [s[:3] for s in pii.scored_spans(text, pii.base_spans(text))] == [(6, 46, "secret")]


def brute_added(text):
    """All proposals of the added kinds, the plain way: each against every span that stands already."""
    base = pii.base_spans(text)
    out, taken = list(base), [s[:2] for s in base]
    for found in pii.proposals(text):
        new = [(a, b, k) for a, b, k in found if not any(x < b and a < y for x, y in taken) and pii.ADDED[k] + pii.CONTEXT_GAIN * pii.in_context(text, a, b, k) >= pii.THRESHOLD]
        out += new
        taken += [s[:2] for s in new]
    return sorted(out, key=lambda s: (s[0], pii.ORDER[s[2]]))


def test_added_kinds_equal_the_plain_way(spark, tmp_path):
    rnd = random.Random(8)
    parts = ["DE89370400440532013000", "078-05-1120", "555-123-4567", "4222222222222", "+1 (555) 123-4567", "f3ef4d6b2755a36d7d9c", "token", "ssn", "card", "phone", "10.0.0.1", "x", "-", " "]
    texts = [rnd.choice(["", " "]).join(rnd.choice(parts) for _ in range(rnd.randint(0, 12))) for _ in range(3000)]
    for t in texts:
        assert [s[:3] for s in pii.scored_spans(t, pii.base_spans(t))] == brute_added(t), t
    d = helpers.write(spark, tmp_path, helpers.table(spark, texts[:300]))
    got = {r.doc_id: r for r in pii.op1_pii(spark, d).collect()}
    for i, t in enumerate(texts[:300]):
        want = brute_added(t)
        assert got[i].spans == ",".join(f"{k}:{a}:{b}" for a, b, k in want) and got[i].n_added == sum(s[2] not in pii.BASE for s in want)
        assert (got[i].top_score is None) == (not want)


def test_added_spans_take_linear_time():
    took = []
    for n in (2000, 16_000):
        text = "call 555-123-4567 " * n
        began = time.process_time()
        assert len(pii.scored_spans(text, pii.base_spans(text))) == n
        took.append(time.process_time() - began)
    assert took[1] < 8 * 4 * took[0]


def test_query_on_edge_cases(spark, tmp_path):
    d = helpers.write(spark, tmp_path, helpers.edge(spark).unionByName(helpers.table(spark, ["mail a@b.co, 10.0.0.1 é 4242 4242 4242 4242"], [9])))
    got = {(r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, r.spans) for r in pii.op1_pii(spark, d).collect()}
    nothing = hashlib.sha256(b"").hexdigest()
    spans = "email:5:11,ip:13:21,card:24:43"
    assert (9, 1, 1, 1, 0, hashlib.sha256(spans.encode()).hexdigest(), spans) in got
    assert {(0, 0, 0, 0, 0, nothing, ""), (None, 0, 0, 0, 0, nothing, "")} <= got
    assert pii.op1_pii(spark, d).count() == 9


def test_empty_table_and_other_columns(spark):
    assert pii.find_pii(helpers.empty(spark)).collect() == []
    out = pii.find_pii(helpers.table(spark, ["a@b.co"])).first()
    assert out.pos == 1 and out.h == "x" and out.pii[0].text == "a@b.co" and out.pii[0].score >= 0.5
