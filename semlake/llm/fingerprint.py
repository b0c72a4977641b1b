"""Document fingerprints: bottom-k sketches of shingle hashes (DataFrame functions only).

A fingerprint is the sorted array of the K least 64-bit hashes of a text's distinct runs of five words
(words between white space, A-Z lower-cased; the whole sequence if there are fewer words).
Sketches of parts merge into the sketch of the whole: the K least of their union. From two sketches follow
resemblance (the share of the K least of the union that both hold), containment and the numbers of distinct
shingles.

Long texts are not sorted whole: hashes under a cut at which half as many again as K are expected are
sorted, and all only if fewer than K of them are distinct; the result is the same.

``with_next`` gives each document the one after it in ascending doc_id without a global sort: quantiles
of doc_id cut the rows into ranges, a range is one window group, and the first row of each range also
goes, marked, to the end of the range before it (that of the first to the last).

Defined results: null texts are empty; texts without words have an empty fingerprint; two empty ones are alike
(1.0), an empty and another are not (0.0); null doc_ids come before all others; rows that share a doc_id
are ordered by text (null text first), each being the other's next; a single document is its own next; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from semlake.llm.common import sha256_hex, table, unused, white_words

K, WORDS = 128, 5
_LONGS = "array<bigint>"


def with_fingerprint(df: DataFrame, text: str, name: str, k: int = K) -> DataFrame:
    """The table with the fingerprint of the column text under that name; a column that has it already is replaced."""
    w, h, low, bound = unused(df, f"{name}_w", f"{name}_h", f"{name}_low", f"{name}_cut")
    n = F.size(w)
    runs = F.transform(F.sequence(F.lit(1), n - WORDS + 1), lambda i: F.xxhash64(F.slice(w, i, F.lit(WORDS))))
    # Each step is used more than once by the next, so Spark keeps it as a column and computes it once.
    df = df.withColumn(w, white_words(F.col(text)))
    df = df.withColumn(h, F.when(n >= WORDS, runs).when(n > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast(_LONGS)))
    share = F.lit(1.5 * k + 30) / F.size(h)
    cut = F.when(share < 0.5, F.lit(-(2.0**63)) + F.lit(2.0**64) * share).otherwise(F.lit(2.0**63)).cast("bigint")
    df = df.withColumn(bound, cut)
    df = df.withColumn(low, F.array_distinct(F.filter(h, lambda x: x < F.col(bound))))
    whole = F.sort_array(F.array_distinct(h))
    least = F.when(F.size(low) >= k, F.sort_array(low)).otherwise(whole)
    return df.withColumn(name, F.slice(least, 1, k)).drop(w, h, low, bound)


def merge(a: Column, b: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_parts(df: DataFrame, by: str, fingerprint: str, k: int = K) -> DataFrame:
    """(by, fingerprint) over the parts of each group; only k hashes of a group leave a task."""
    each = df.select(by, F.explode(fingerprint).alias("h")).distinct()
    first = W.partitionBy(by).orderBy("h")
    kept = each.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k)
    return kept.groupBy(by).agg(F.array_sort(F.collect_list("h")).alias(fingerprint))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    least = merge(a, b, k)
    both = F.size(F.array_intersect(F.array_intersect(least, a), b))
    return F.when(F.size(least) == 0, F.lit(1.0)).otherwise(both / F.size(least))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Exact under k; else from how far the k-th hash reaches into the range."""
    reach = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / reach)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has; 1 for an empty a."""
    j, na, nb = resemblance(a, b, k), distinct_shingles(a, k), distinct_shingles(b, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), j * (na + nb) / ((1 + j) * na)))


def to_text(fingerprint: Column) -> Column:
    return F.array_join(F.transform(fingerprint, lambda x: F.lower(F.hex(x))), ",")


def with_next(docs: DataFrame, ranges: int | None = None) -> tuple[DataFrame, W]:
    """(doc_id, text, copy, bucket) in ranges of doc_id, and the window in which the next row is the next document.
    Rows with copy = 1 only serve as next rows and are to be dropped afterwards."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ranges = ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = docs.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], min(0.01, 0.1 / ranges)) if ranges > 1 else []
    bounds = sorted({int(b) for b in bounds})
    if bounds:
        # Binary search: how many bounds are at most doc_id.
        held = F.array(*[F.lit(b).cast("bigint") for b in bounds])
        steps = F.sequence(F.lit(1), F.lit(len(bounds).bit_length()))
        start = F.struct(F.lit(0).alias("a"), F.lit(len(bounds)).alias("b"))
        middle = lambda s: ((s.a + s.b) / 2).cast("int")
        up = lambda s: (s.a < s.b) & (F.get(held, middle(s)) <= F.col("doc_id"))
        step = lambda s, _: F.struct(F.when(up(s), middle(s) + 1).otherwise(s.a).alias("a"), F.when(up(s) | (s.a >= s.b), s.b).otherwise(middle(s)).alias("b"))
        bucket = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(F.aggregate(steps, start, step, lambda s: s.a))
    else:
        bucket = F.lit(0)
    docs = docs.withColumn("bucket", bucket)
    firsts = docs.groupBy("bucket").agg(F.min("doc_id").alias("first"), F.max(F.col("doc_id").isNull()).alias("null")).orderBy("bucket").collect()  # one row a range
    before = {r["bucket"]: firsts[i - 1]["bucket"] for i, r in enumerate(firsts)}
    links = spark.createDataFrame([(r["bucket"], None if r["null"] else r["first"], before[r["bucket"]]) for r in firsts], "b int, first bigint, before int")
    spots = F.array(F.struct(F.col("bucket"), F.lit(0).alias("copy")))
    more = F.array(F.struct(F.col("bucket"), F.lit(0).alias("copy")), F.struct(F.col("before").alias("bucket"), F.lit(1).alias("copy")))
    docs = docs.join(F.broadcast(links), F.col("bucket") == F.col("b"))
    docs = docs.withColumn("spot", F.explode(F.when(F.col("doc_id").eqNullSafe(F.col("first")), more).otherwise(spots)))
    docs = docs.select("doc_id", "text", "spot.bucket", "spot.copy")
    return docs, W.partitionBy("bucket").orderBy("copy", F.col("doc_id").asc_nulls_first(), "text")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, order = with_next(table(spark, sf_dir, "documents"))
    docs = docs.withColumn("next", F.lead("text").over(order))
    half = F.floor(F.length("text") / 2).cast("int")
    docs = docs.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next", F.lit(1), half)))
    docs = with_fingerprint(docs.drop("next"), "text", "fp").withColumn("next_fp", F.lead("fp").over(order)).where("copy = 0")
    docs = docs.select("doc_id", F.length("text").cast("long").alias("n_chars"), "edited", "fp", "next_fp")
    docs = with_fingerprint(docs, "edited", "edited_fp")
    return docs.select(
        "doc_id",
        "n_chars",
        sha256_hex(F.col("edited")).alias("edited_sha256"),
        to_text(F.col("fp")).alias("fingerprint"),
        to_text(F.col("edited_fp")).alias("edited_fingerprint"),
        resemblance(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        resemblance(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
