import random
import zlib

import numpy as np

from semlake.llm import toxicity as tx
from tests.llm import brute, helpers


def corpus(n):
    rnd = random.Random(9)
    vocab = ["".join(rnd.choice("aeinorst") for _ in range(rnd.randint(2, 7))) for _ in range(300)]
    texts, labels = [], []
    for _ in range(n):
        w = [rnd.choice(vocab) for _ in range(rnd.randint(10, 60))]
        bad = rnd.random() < 0.25
        if bad:
            w[rnd.randrange(len(w))] = rnd.choice(["zukkbah", "Zukkbah,", "wuzzgrim"])
        texts.append(" ".join(w))
        labels.append(int(bad))
    return texts, labels


def test_held_out_accuracy(spark, tmp_path):
    texts, labels = corpus(1500)
    d = helpers.write(spark, tmp_path, helpers.table(spark, texts), spark.createDataFrame(list(enumerate(labels)), "doc_id bigint, toxic int"))
    rows = tx.op6_toxicity(spark, d).collect()
    assert len(rows) == 1500
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(r.predicted == labels[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)


def test_rare_terms_count(spark, tmp_path):
    texts, labels = corpus(400)
    d = helpers.write(spark, tmp_path, helpers.table(spark, texts), spark.createDataFrame(list(enumerate(labels)), "doc_id bigint, toxic int"))
    held = [(r.predicted, labels[r.doc_id]) for r in tx.op6_toxicity(spark, d).collect() if r.held_out]
    assert held.count((1, 1)) > 0.9 * sum(y for _, y in held) and held.count((1, 0)) == 0


def test_held_out_labels_are_not_used(spark):
    texts, labels = corpus(300)
    docs = helpers.table(spark, texts)
    frame = lambda y: spark.createDataFrame(y, "doc_id bigint, toxic int")
    held = [zlib.crc32(str(i).encode()) % 5 == 0 for i in range(300)]
    a = tx.train(docs, frame(list(enumerate(labels))))
    b = tx.train(docs, frame([(i, 1 - y if h else y) for i, (y, h) in enumerate(zip(labels, held, strict=True))]))
    assert (a[0] == b[0]).all() and a[1] == b[1]


def test_sample_is_of_documents_that_exist(spark, monkeypatch):
    texts, labels = corpus(300)
    seen = []
    monkeypatch.setattr(tx, "fit", lambda t, y, ratio, fit=tx.fit: seen.append((t.to_pylist(), y)) or fit(t, y, ratio))
    # Most labels have no document, and one labelled document repeats.
    hot = next(i for i, y in enumerate(labels) if y and zlib.crc32(str(i).encode()) % 5)
    docs = helpers.table(spark, texts + [texts[hot]] * 500, [*range(300), *[hot] * 500])
    known = spark.createDataFrame([*enumerate(labels), *[(i, i % 2) for i in range(1000, 8000)]], "doc_id bigint, toxic int")
    tx.train(docs, known, 60)
    tx.train(docs, known)
    (few, few_y), (every, every_y) = seen
    assert len(few) == 60 and few_y.sum() == 30
    train = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5]
    assert sorted(every) == sorted(texts[i] for i in train) and every_y.sum() == sum(labels[i] for i in train)


def test_edges(spark):
    docs = helpers.edge(spark)
    frame = lambda y: spark.createDataFrame(y, "doc_id bigint, toxic int")
    none = tx.train(docs, frame([]))
    out = tx.score(docs, none).collect()
    assert len(out) == 8 and {round(r.tx_score, 6) for r in out} == {0.25} and out[0].pos == 1
    assert tx.score(helpers.empty(spark), none).collect() == []
    # A label twice, with a null and of one class only.
    one = tx.train(docs, frame([(4, 0), (4, 1), (5, None), (None, 1), (0, 1)]))
    assert tx.score(docs, one).where("tx_score > 0.5").count() == 8
    assert sorted(map(tuple, tx.training_labels(frame([(1, 0), (1, 1), (2, 0), (None, 1), (3, None)])).collect())) == sorted((i, y) for i, y in ((1, 1), (2, 0)) if zlib.crc32(str(i).encode()) % 5)


def test_counts_ratios_and_scores_equal_plain_python(spark, tmp_path):
    texts, labels = corpus(60)
    texts += [None, "", "  ", "Ünï çode 12", "a", helpers.LONG[:4000]]
    labels += [0, 1, 0, 1, 0, 1]
    rows = spark.createDataFrame(list(zip(texts, labels, strict=True)), "text string, tx_label int").repartition(3)
    q, p = tx.class_counts(rows)
    want_q, want_p, _ = brute.ratios(texts, labels)
    assert q.tolist() == want_q.tolist() and p.tolist() == want_p.tolist()
    docs = helpers.table(spark, texts)
    lab = spark.createDataFrame(list(enumerate(labels)), "doc_id bigint, toxic int")
    model = tx.train(docs, lab)
    # A weight is the ratio times what the regression gave: none where the ratio is none or within the gate.
    known = {r.tx_id: r.tx_label for r in tx.training_labels(lab).collect()}
    q, p, ratio = brute.ratios([texts[i] for i in known], list(known.values()))
    gate = np.abs(ratio) < tx.SIGNIFICANT * np.sqrt(1 / (p + 1) + 1 / (q + 1))
    assert not model[0][gate].any() and model[0][~gate].any()
    d = helpers.write(spark, tmp_path, docs, lab)
    got = {r.doc_id: r for r in tx.op6_toxicity(spark, d).collect()}
    for i, t in enumerate(texts):
        want = brute.score(t, model)
        assert abs(got[i].score - want) < 1e-5 and got[i].predicted == int(got[i].score >= 0.5)
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
