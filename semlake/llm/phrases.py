"""Phrase collocation mining by pivot partitioning, as in MG-FSM (Miliaraki et al., 2013).

Texts (A-Z lower-cased) are split at ``.,;:!?`` and line ends into pieces, and those at spaces and tabs into words. All is
done for each language (null: ``und``). A phrase of two or three words that occurs MIN_COUNT times or more, overlaps included, is a
candidate.

1. Words are counted, and the TABLE most frequent short ones of all languages are numbered, most frequent first; that bounded
   table goes to the tasks. The other words count as rarer than all of these, and have a 63-bit hash as their
   number (another salt is taken if two words of the corpus share one). If the table holds every word that is frequent enough, the others
   can be in no candidate.
2. The *pivot* of an n-gram is its rarest word, the one with the highest number. Around each word of a piece a fragment
   of up to two words on either side is kept, as far as no rarer word comes (to its left, no equal one either): it
   holds just those n-grams whose leftmost pivot it is. Fragments are routed by their pivot; equal ones of
   frequent words are combined before. A pivot with more than SPLIT occurrences is dealt to several places by its fragments.
3. Places travel in regions of neighbouring ones, so that a portion of text makes a row for each region only. Each place counts its n-grams on its own. Those of a pivot that was not dealt out are whole there, and
   leave only as candidates; the counts of the others are added up.
4. Joins on word numbers give the counts of a candidate's parts; products are exact decimals.

Defined results: null, empty and blank texts have no words; very long texts and words are mined whole; repeated rows count each; an
empty table gives an empty result; columns other than ``text`` and ``lang`` are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from semlake.llm.bytewords import mix
from semlake.llm.common import broadcast_within, hold_only, materialise, remove, row_slices, scratch, ship, table

MIN_COUNT, SHARE, TOP = 10, 50, 2000
#: Words in the table that goes to the tasks (below 2**21), and bytes of the longest of them.
TABLE, TABLE_WORD = 1 << 17, 64
#: Fragments in a place, about, places in a region, and occurrences from which a pivot is dealt out.
PLACE, REGION, SPLIT = 200_000, 5, 200_000
#: Equal fragments of so many most frequent words are combined: five numbers below 2**12 make one.
DENSE = (1 << 12) - 2
#: Bytes of text worked on at once, and words that a task counts before it passes them on.
STEP_BYTES, HELD = 1 << 20, 300_000
_U = np.uint64
#: Not a byte of UTF-8: marks the end of a piece.
END = b"\xff"
_BYTES = bytearray(range(256))
for _c in range(65, 91):
    _BYTES[_c] = _c + 32
for _c in b".,;:!?\n\x0b\x0c\r":
    _BYTES[_c] = 0xFF
_BYTES[9] = 32
_BYTES = bytes(_BYTES)


def words_of(texts: list[str]) -> list[bytes]:
    """The words of the texts' pieces, END after each piece."""
    joined = "\n".join(texts).encode().translate(_BYTES)
    return joined.replace(END, b" \xff ").split()


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, list[bytes]]]:
    """Words of a portion of the texts, one language at a time."""
    for at, n in row_slices(batch.column("text"), STEP_BYTES):
        part = batch.slice(at, n)
        texts: dict[str, list[str]] = {}
        for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
            if text:
                texts.setdefault(lang, []).append(text)
        for lang, group in texts.items():
            yield lang, [*words_of(group), END]


def count_words(docs: DataFrame) -> DataFrame:
    """(lang, word, n) of all words, as (text, lang) gives them."""
    owner = __name__
    ship(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_only(owner)
        seen: dict[str, Counter] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, count in seen.items():
                count.pop(END, 0)
                words = pa.array(list(count), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(count), pa.string()), words, pa.array(list(count.values()), pa.int64())], names=["lang", "word", "n"])
            seen.clear()

        for batch in batches:
            for lang, words in _by_lang(batch):
                seen.setdefault(lang, Counter()).update(words)
                if sum(map(len, seen.values())) > HELD:
                    yield from out()
        yield from out()

    return docs.select("text", "lang").mapInArrow(each, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))


class Order(NamedTuple):
    """The order of words: numbers of those in the table, how often each occurs, the most that any other word
    does, whether others can be frequent, and the salt of their hashes."""

    table: dict[str, dict[bytes, int]]
    count: np.ndarray
    other: int
    open: bool
    salt: str


def hashed(word: str, salt: str):
    """The number of a word that is not in the table."""
    return F.shiftrightunsigned(F.xxhash64(F.concat(F.lit(salt), F.col(word))), 2).bitwiseOR(F.lit(1 << 62))


def hashed_bytes(word: bytes, salt: bytes) -> int:
    return xxh64_intdigest(salt + word, 42) >> 2 | 1 << 62


def word_order(vocab: DataFrame, least: int, most: int) -> Order:
    """vocab: (lang, word, n), written."""
    chosen = vocab.where((F.col("n") >= least) & (F.octet_length("word") <= TABLE_WORD)).orderBy(F.desc("n"), "lang", "word").limit(most).toArrow()  # at most `most` short words
    langs, words, count = (chosen.column(c).to_pylist() for c in ("lang", "word", "n"))
    ids: dict[str, dict[bytes, int]] = {}
    for i, (lang, word) in enumerate(zip(langs, words, strict=True)):
        ids.setdefault(lang, {})[word.encode()] = i
    rest = vocab.where(F.col("n") >= least).agg(F.count("*").alias("all"), F.max(F.when(F.octet_length("word") > TABLE_WORD, F.col("n"))).alias("long")).first()
    others = rest["all"] > len(count)
    salt = ""
    while others:
        both = vocab.select("word", hashed("word", salt).alias("h")).distinct().agg(F.count("*").alias("n"), F.count_distinct("h").alias("h")).first()
        if both["n"] == both["h"]:
            break
        salt += "~"
    return Order(ids, np.array(count, np.int64), max(rest["long"] or 0, count[-1] if count and others else 0), others, salt)


def fragments(ids: np.ndarray) -> np.ndarray:
    """(5, n): for each word its two neighbours to the left, itself, and two to the right, -1 where a rarer word or the piece's end
    comes first; only words with a neighbour."""
    n = len(ids)
    wide = np.full(n + 4, -1, np.int64)
    wide[2:-2] = ids
    x = ids
    l1, r1 = wide[1 : n + 1], wide[3 : n + 3]
    l1 = np.where(l1 < x, l1, -1)
    r1 = np.where(r1 <= x, r1, -1)
    l2, r2 = wide[:n], wide[4:]
    l2 = np.where((l2 < x) & (l1 >= 0), l2, -1)
    r2 = np.where((r2 <= x) & (r1 >= 0), r2, -1)
    some = np.flatnonzero((x >= 0) & ((l1 >= 0) | (r1 >= 0)))
    return np.stack([l2[some], l1[some], x[some], r1[some], r2[some]])


def combine(five: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fragments with their numbers, equal ones of the most frequent words combined."""
    dense = five[2] <= DENSE
    key = np.zeros(int(dense.sum()), np.int64)
    for row in five[:, dense]:
        key = key << 12 | row + 1
    key, n = np.unique(key, return_counts=True)
    few = np.stack([(key >> 12 * (4 - k) & 0xFFF) - 1 for k in range(5)])
    return np.concatenate([few, five[:, ~dense]], axis=1), np.concatenate([n, np.ones(five.shape[1] - int(dense.sum()), np.int64)])


def route(five: np.ndarray, lang: str, order: Order, places: int) -> np.ndarray:
    """The place of each fragment, by its pivot; a pivot that is dealt out, by the fragment too."""
    pivot = five[2]
    often = np.full(len(pivot), order.other, np.int64)
    known = pivot < len(order.count)
    often[known] = order.count[pivot[known]]
    spread = -(-often // SPLIT)
    part = np.zeros(five.shape[1], np.uint64)
    if (spread > 1).any():
        for row in five:
            part = mix(part * _U(0x9E3779B97F4A7C15) + row.astype(np.uint64))
    part %= np.maximum(spread, 1).astype(np.uint64)
    start = _U(xxh64_intdigest(lang.encode(), 7))
    return (mix(mix(pivot.astype(np.uint64) ^ start) + part) % _U(places)).astype(np.int64)


def routed(docs: DataFrame, order: Order, places: int) -> DataFrame:
    """(region, lang, data): places, fragments and their numbers as bytes (seven rows of numbers, by place), all of a portion that go to
    one region in one row."""
    owner, held, region = __name__, docs.sparkSession.sparkContext.broadcast(order), REGION

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_only(owner)
        order: Order = held.value
        salt = order.salt.encode()
        for batch in batches:
            for lang, words in _by_lang(batch):
                known = order.table.get(lang, {})
                if order.open:
                    known = known | {w: hashed_bytes(w, salt) for w in set(words).difference(known, (END,))}
                ids = np.fromiter(map(known.get, words, repeat(-1)), np.int64, len(words))
                five, n = combine(fragments(ids))
                if not five.shape[1]:
                    continue
                place = route(five, lang, order, places)
                data = np.concatenate([place[None], five, n[None]])[:, np.argsort(place, kind="stable")]
                at = data[0] // region
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1, [len(at)]])
                sides = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
                columns = [pa.array(at[cuts[:-1]]), pa.array([lang] * len(sides), pa.string()), pa.array([np.ascontiguousarray(data[:, a:b]).tobytes() for a, b in sides], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["region", "lang", "data"])

    return docs.select("text", "lang").mapInArrow(each, "region bigint, lang string, data binary")


def mine(five: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(3, k) n-grams of fragments that hold their pivot, -1 for no third word, and their counts."""
    values, code = np.unique(five, return_inverse=True)
    bits = len(values).bit_length()
    l2, l1, x, r1, r2 = code.reshape(five.shape)
    none = int(np.searchsorted(values, -1)) if len(values) and values[0] < 0 else -1
    there = lambda *parts: np.logical_and.reduce([p != none for p in parts])
    blank = np.full(len(x), len(values))
    grams = ((l1, x, blank), (x, r1, blank), (l2, l1, x), (l1, x, r1), (x, r1, r2))
    keys, weight = [], []
    for a, b, c in grams:
        some = np.flatnonzero(there(a, b, c))
        if 3 * (bits + 1) <= 63:
            keys.append((a[some] << 2 * (bits + 1)) | (b[some] << bits + 1) | c[some])
        else:
            keys.append(np.stack([a[some], b[some], c[some]], axis=1))
        weight.append(n[some])
    keys, weight = np.concatenate(keys), np.concatenate(weight)
    keys, back = np.unique(keys, axis=None if keys.ndim == 1 else 0, return_inverse=True)
    total = np.bincount(back.reshape(-1), weight, len(keys)).astype(np.int64)  # exact below 2**53
    if keys.ndim == 1:
        mask = (1 << bits + 1) - 1
        keys = np.stack([keys >> 2 * (bits + 1), keys >> bits + 1 & mask, keys & mask], axis=1)
    return np.append(values, -1)[keys].T.reshape(3, -1), total


def local_counts(fragments_: DataFrame, order: Order, least: int) -> DataFrame:
    """(lang, w1, w2, w3, n): frequent n-grams whose pivot is whole in its place, and partial counts of the others."""
    owner, spark = __name__, fragments_.sparkSession
    whole_from = int((order.count > SPLIT).sum())  # numbers from here on are not dealt out
    split_others = order.other > SPLIT
    n_table = len(order.count)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_only(owner)
        key, parts = None, []

        def out() -> Iterator[pa.RecordBatch]:
            if not parts:
                return
            data = np.concatenate(parts, axis=1)
            parts.clear()
            data = data[:, np.argsort(data[0], kind="stable")]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(data[0])) + 1, [data.shape[1]]]).tolist()
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                grams, n = mine(data[1:6, a:b], data[6, a:b])
                pivot = grams.max(0, initial=-1)
                dealt = (pivot < whole_from) | (split_others & (pivot >= n_table))
                some = np.flatnonzero(dealt | (n >= least))
                columns = [pa.array([key[1]] * len(some), pa.string()), *(pa.array(g[some]) for g in grams), pa.array(n[some])]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "w1", "w2", "w3", "n"])

        for batch in batches:
            data = batch.column("data")
            for i, now in enumerate(zip(batch.column("region").to_pylist(), batch.column("lang").to_pylist(), strict=True)):
                if now != key:
                    yield from out()
                    key = now
                parts.append(np.frombuffer(data[i].as_buffer(), np.int64).reshape(7, -1))
        yield from out()

    ordered = fragments_.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "region").sortWithinPartitions("region", "lang")
    return ordered.mapInArrow(each, "lang string, w1 bigint, w2 bigint, w3 bigint, n bigint")


def candidates(docs: DataFrame, path: str, least: int = MIN_COUNT, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(lang, w1, w2, w3, a) of all candidates, w3 -1 in those of two words; and the words (lang, id, word, n)."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select("text", F.coalesce("lang", F.lit("und")).alias("lang"))
    vocab = materialise(count_words(docs), f"{path}/words")
    order = word_order(vocab, least, TABLE if most is None else most)
    total = vocab.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    places = max(1, -(-total // PLACE))
    got = materialise(local_counts(routed(docs, order, places), order, least), f"{path}/grams")
    got = got.groupBy("lang", "w1", "w2", "w3").agg(F.sum("n").alias("a")).where(F.col("a") >= least)
    ranked = vocab.where(F.col("n") >= least)
    in_table = [(lang, w.decode(), i) for lang, ws in order.table.items() for w, i in ws.items()]
    numbers = spark.createDataFrame(pa.table({"l": pa.array([x[0] for x in in_table], pa.string()), "w": pa.array([x[1] for x in in_table], pa.string()), "i": pa.array([x[2] for x in in_table], pa.int64())}))
    known = ranked.join(F.broadcast(numbers), (F.col("lang") == F.col("l")) & (F.col("word") == F.col("w")), "left")  # at most TABLE short words
    words = known.select("lang", F.coalesce("i", hashed("word", order.salt)).alias("id"), "word", "n")
    return materialise(got, f"{path}/candidates"), materialise(words, f"{path}/numbers")


def scored(found: DataFrame, words: DataFrame, share: int = SHARE) -> DataFrame:
    """(lang, w1, w2, w3, a, l, r, score) of the candidates that no longer one stands for."""
    n_words, n_found = words.count(), found.count()
    freq = words.select("lang", "id", "n")

    def count_of(df: DataFrame, by: str, name: str) -> DataFrame:
        other = freq.select(F.col("lang").alias("_l"), F.col("id").alias("_i"), F.col("n").alias(name))
        return df.join(broadcast_within(other, n_words * 40), (F.col("lang") == F.col("_l")) & (F.col(by) == F.col("_i"))).drop("_l", "_i")

    pairs, threes = found.where("w3 < 0"), found.where("w3 >= 0")

    def pair_of(df: DataFrame, x: str, y: str, name: str) -> DataFrame:
        other = pairs.select(F.col("lang").alias("_l"), F.col("w1").alias("_x"), F.col("w2").alias("_y"), F.col("a").alias(name))
        on = (F.col("lang") == F.col("_l")) & (F.col(x) == F.col("_x")) & (F.col(y) == F.col("_y"))
        return df.join(broadcast_within(other, n_found * 48), on).drop("_l", "_x", "_y")

    exact = lambda l, r: F.expr(f"cast((1000000 * cast(a as decimal(15,0)) * cast(a as decimal(15,0))) div (cast({l} as decimal(18,0)) * cast({r} as decimal(18,0))) as bigint)")  # noqa: E731, E741
    # Two words: dropped if a longer candidate that holds them has enough of their occurrences.
    longer = threes.select("lang", F.explode(F.array(F.struct("w1", "w2"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2")))).alias("p"), "a")
    longer = longer.groupBy(F.col("lang").alias("_l"), F.col("p.w1").alias("_x"), F.col("p.w2").alias("_y")).agg(F.max("a").alias("most"))
    on = (F.col("lang") == F.col("_l")) & (F.col("w1") == F.col("_x")) & (F.col("w2") == F.col("_y"))
    two = pairs.join(longer, on, "left").where(f"most is null or 100 * most < {share} * a").select("lang", "w1", "w2", "w3", "a")
    two = count_of(count_of(two, "w1", "l"), "w2", "r").withColumn("score", exact("l", "r"))
    three = pair_of(pair_of(count_of(count_of(threes, "w1", "l1"), "w3", "r2"), "w2", "w3", "r1"), "w1", "w2", "l2")
    three = three.withColumns({"s1": exact("l1", "r1"), "s2": exact("l2", "r2")})
    first = F.col("s1") <= F.col("s2")
    three = three.withColumns({"l": F.when(first, F.col("l1")).otherwise(F.col("l2")), "r": F.when(first, F.col("r1")).otherwise(F.col("r2")), "score": F.least("s1", "s2")})
    names = ("lang", "w1", "w2", "w3", "a", "l", "r", "score")
    return two.select(*names).union(three.select(*names))


def phrases(docs: DataFrame, least: int = MIN_COUNT, share: int = SHARE, top: int = TOP, most: int | None = None) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases."""
    spark = docs.sparkSession
    path = scratch(spark)
    found, words = candidates(docs, path, least, most)
    totals = spark.read.parquet(f"{path}/words").groupBy(F.col("lang").alias("_t")).agg(F.sum("n").alias("n"))
    # Ties with the last place stay until the phrases' texts can be compared.
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    out = materialise(scored(found, words, share).withColumn("_k", F.rank().over(best)).where(F.col("_k") <= top).drop("_k"), f"{path}/scored")
    size = words.agg(F.sum(F.octet_length("word") + 40)).first()[0] or 0
    for i in (1, 2, 3):
        other = words.select(F.col("lang").alias("_l"), F.col("id").alias("_i"), F.col("word").alias(f"t{i}"))
        out = out.join(broadcast_within(other, size), (F.col("lang") == F.col("_l")) & (F.col(f"w{i}") == F.col("_i")), "left").drop("_l", "_i")
    out = out.withColumn("phrase", F.concat_ws(" ", "t1", "t2", "t3"))
    place = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    out = out.withColumn("rank", F.row_number().over(place).cast("long")).where(F.col("rank") <= top)
    out = out.join(totals, F.col("lang") == F.col("_t")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    out = materialise(out, f"{path}/result")
    for part in ("words", "grams", "candidates", "numbers", "scored"):
        remove(spark, f"{path}/{part}")
    return out


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH p AS (
  SELECT doc, lang, j, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w
  FROM (SELECT doc, lang, unnest(ps) AS piece, unnest(range(len(ps))) AS j
        FROM (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
                     regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps
              FROM documents))),
g AS (
  SELECT lang, len(s) AS k, s, count(*) AS a
  FROM (SELECT lang, unnest(list_concat(
          list_transform(range(1, len(w) + 1), lambda i: w[i:i]),
          list_transform(range(1, len(w)), lambda i: w[i:i + 1]),
          list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2]))) AS s FROM p WHERE len(w) > 0)
  GROUP BY lang, s),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM g WHERE k > 1 AND a >= 10),
cuts AS (
  SELECT c.lang, c.s, c.k, c.a, x.k AS first, x.a AS l, y.a AS r,
         CAST((1000000::HUGEINT * c.a * c.a) // (x.a::HUGEINT * y.a) AS BIGINT) AS score
  FROM c JOIN g x ON x.lang = c.lang AND x.k < c.k AND x.s = c.s[1:x.k] JOIN g y ON y.lang = c.lang AND y.k = c.k - x.k AND y.s = c.s[x.k + 1:c.k]),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, s ORDER BY score, first) = 1),
longer AS (SELECT lang, s2, max(a) AS most FROM (SELECT lang, s[1:2] AS s2, a FROM c WHERE k = 3 UNION ALL SELECT lang, s[2:3], a FROM c WHERE k = 3) GROUP BY lang, s2),
kept AS (SELECT z.* FROM lowest z LEFT JOIN longer o ON o.lang = z.lang AND o.s2 = z.s WHERE o.most IS NULL OR 100 * o.most < 50 * z.a),
ranked AS (SELECT lang, array_to_string(s, ' ') AS phrase, a, l, r, score,
                  row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(s, ' ')) AS rank FROM kept)
SELECT ranked.lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n ON n.lang = ranked.lang WHERE rank <= 2000
"""
