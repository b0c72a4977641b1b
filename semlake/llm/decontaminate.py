"""Benchmark decontamination with a broadcast hash set of n-grams (DataFrame functions only).

Words are maximal runs of digits, a-z (after lower-casing A-Z) and code points above
0x7F. Every run of ``n`` item words is a window; an item with fewer words, but not
none, is one window of its own length. Document windows of the lengths that occur are
hashed, looked up in the hash set, and each hit is verified on the words themselves.

The set is broadcast while its measured size stays within BROADCAST_BYTES; a larger
benchmark is joined by a shuffle on the window hash. Hits are kept per distinct text
(two 64-bit hashes), so copies meet once and doc_ids may repeat or be null.

Defined results: null, empty or wordless texts have no words, no hits and no items;
null item texts have no windows; items with the same window all count; a document
shorter than every window has no hits; repeated rows are answered one by one; empty
tables give empty or clean results; other columns are carried through untouched, but for those
named like the new ones, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from semlake.llm.common import ascii_lower, broadcast_within, digest128, materialise, others, remove, scratch, sha256_hex, table, unused

N = 10
GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP), "")


def _windows(w: str, length: int) -> Column:
    """Hashes of the windows of that length in the array column w, by position."""
    last = F.size(w) - length
    spots = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(spots, lambda i: F.xxhash64(F.slice(w, i + 1, F.lit(length))))


def benchmark_windows(bench: DataFrame, n: int = N) -> DataFrame:
    """(item_id, len, h, gram): the distinct windows of each item; gram is the words themselves."""
    w = bench.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    w = w.withColumn("len", F.least(F.size("w"), F.lit(n)))
    grams = F.transform(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1), lambda i: F.slice("w", i, F.col("len")))
    return w.select("item_id", "len", F.explode(F.array_distinct(grams)).alias("gram")).withColumn("h", F.xxhash64("gram"))


def hits(docs: DataFrame, bench: DataFrame, n: int = N, path: str | None = None) -> tuple[DataFrame, int]:
    """Per distinct text with hits: (ta, tb, dc_hit, dc_items), and the bytes they take.

    dc_hit: positions of the words inside windows; dc_items: ids of the items, as sorted strings. Windows meet their
    items once for each distinct set of windows that a text holds, not for each occurrence."""
    spark = docs.sparkSession
    path = path or scratch(spark)
    grams = materialise(benchmark_windows(bench, n), f"{path}/grams")
    windows = materialise(grams.select("len", "h", "gram").distinct().withColumn("wid", F.monotonically_increasing_id()), f"{path}/windows")
    lengths = sorted(r[0] for r in windows.select("len").distinct().collect())  # at most n values
    if not lengths:
        return spark.createDataFrame([], "ta bigint, tb bigint, dc_hit array<int>, dc_items array<string>"), 0
    size = windows.agg(F.coalesce(F.sum(F.length(F.concat_ws(" ", "gram")) * 4 + 64), F.lit(0))).first()[0]
    held = docs.select(digest128(F.coalesce("text", F.lit(""))).alias("t"), words(F.col("text")).alias("w"))
    held = held.where(F.size("w") > 0)
    if len(lengths) == 1:
        found = held.select("t", F.lit(lengths[0]).alias("len"), F.posexplode(_windows("w", lengths[0])).alias("pos", "h"))
    else:  # the windows of all lengths in one scan
        spots = lambda k: F.transform(_windows("w", k), lambda h, i: F.struct(F.lit(k).alias("len"), i.alias("pos"), h.alias("h")))
        found = held.select("t", F.explode(F.concat(*map(spots, lengths))).alias("x")).select("t", "x.*")
    found = found.join(broadcast_within(windows.select("h", "len").distinct(), size), ["h", "len"], "left_semi")
    found = found.groupBy(F.col("t.a").alias("ta"), F.col("t.b").alias("tb"), "pos", "len").agg(F.first("h").alias("h"))
    found = materialise(found, f"{path}/found")
    # Verify: the words of the texts with hits against the windows themselves. A text has one row
    # here however often it is copied; the copies are combined before the shuffle.
    some = found.groupBy("ta", "tb").agg(F.collect_set(F.struct("pos", "len", "h")).alias("at"))
    bytes_some = found.count() * 32
    texts = docs.select(F.coalesce("text", F.lit("")).alias("s")).withColumn("t", digest128(F.col("s")))
    texts = texts.join(broadcast_within(some, bytes_some), (F.col("t.a") == F.col("ta")) & (F.col("t.b") == F.col("tb")))
    texts = texts.groupBy("ta", "tb").agg(F.first("s").alias("s"), F.first("at").alias("at"))
    w = texts.select("ta", "tb", "at", words(F.col("s")).alias("w"))
    w = w.select("ta", "tb", F.explode(F.transform("at", lambda x: F.struct(x.pos.alias("pos"), x.len.alias("len"), x.h.alias("h"), F.slice("w", x.pos + 1, x.len).alias("seen")))).alias("x")).select("ta", "tb", "x.*")
    true = w.join(broadcast_within(windows, size), ["h", "len"]).where("seen = gram")
    covered = F.array_distinct(F.flatten(F.collect_list(F.sequence(F.col("pos"), F.col("pos") + F.col("len") - 1))))
    per = true.groupBy("ta", "tb").agg(covered.alias("dc_hit"), F.array_sort(F.collect_set("wid")).alias("wids"))
    per = materialise(per.withColumns({"sa": F.xxhash64("wids"), "sb": F.xxhash64(F.lit(0x5EED), "wids")}), f"{path}/texts")
    links = grams.join(broadcast_within(windows, size), ["len", "h", "gram"]).select("wid", "item_id")
    sets = per.groupBy("sa", "sb").agg(F.first("wids").alias("wids")).select("sa", "sb", F.explode("wids").alias("wid")).join(links, "wid")
    sets = sets.groupBy("sa", "sb").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("dc_items"))
    sets = materialise(sets, f"{path}/sets")
    items = sets.agg(F.coalesce(F.sum(F.size("dc_items") * 32 + 64), F.lit(0))).first()[0]
    per = per.join(broadcast_within(sets, items), ["sa", "sb"], "left").select("ta", "tb", "dc_hit", F.coalesce("dc_items", F.array().cast("array<string>")).alias("dc_items"))
    per = materialise(per, f"{path}/hits")
    for part in ("grams", "windows", "found", "texts", "sets"):
        remove(spark, f"{path}/{part}")
    return per, per.agg(F.coalesce(F.sum(F.size("dc_hit") * 4 + F.size("dc_items") * 32 + 64), F.lit(0))).first()[0]


def decontaminate(docs: DataFrame, bench: DataFrame, n: int = N) -> DataFrame:
    """The documents with dc_words, dc_hit (positions of hit words) and dc_items (ids as sorted strings)."""
    per, size = hits(docs, bench, n)
    t, ta, tb, hit, items = unused(docs, "dc_t", "ta", "tb", "dc_hit_of", "dc_items_of")
    per = per.toDF(ta, tb, hit, items)
    out = docs.withColumn(t, digest128(F.coalesce("text", F.lit(""))))
    out = out.join(broadcast_within(per, size), (F.col(f"{t}.a") == F.col(ta)) & (F.col(f"{t}.b") == F.col(tb)), "left")
    none = F.array()
    return out.select(
        *others(docs, ["dc_words", "dc_hit", "dc_items"]),
        F.size(words(docs["text"])).cast("long").alias("dc_words"),
        F.coalesce(F.col(hit), none.cast("array<int>")).alias("dc_hit"),
        F.coalesce(F.col(items), none.cast("array<string>")).alias("dc_items"),
    )


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id",
        F.col("dc_words").alias("n_words"),
        F.size("dc_hit").cast("long").alias("n_hit"),
        F.size("dc_items").cast("long").alias("n_items"),
        sha256_hex(F.array_join("dc_items", ",")).alias("items_sha256"),
        (F.size("dc_hit") > 0).alias("contaminated"),
    )


OP9_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS d, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
b AS (
  SELECT item_id, w, least(len(w), 10) AS n FROM (
    SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
    FROM benchmark) WHERE len(w) > 0),
g AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
p AS (SELECT d, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram
      FROM (SELECT d, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM b) WHERE len(w) >= n)),
m AS (SELECT d, i, p.n, item_id FROM p JOIN g ON p.n = g.n AND p.gram = g.gram),
c AS (SELECT d, count(DISTINCT j) AS n_hit FROM (SELECT d, unnest(range(i, i + n)) AS j FROM m) GROUP BY d),
t AS (SELECT d, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT d, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY d)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON d.d = c.d LEFT JOIN t ON d.d = t.d
"""
