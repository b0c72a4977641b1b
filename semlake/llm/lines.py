"""Line dedup over levelled sorted runs of line hashes (DataFrame functions only).

``LineRuns`` is a small log-structured index. A run is a folder of
(a, b, n): the 128-bit hash of a line key and the number of documents that hold
it, in hash buckets and sorted by hash within each. Adding a batch counts its keys, merge-anti-joins each run's keys
that are known to be frequent, and writes the rest as a new run of level 0. Two runs of a level are merged into one
of the next by a full merge join, so a key is rewritten once per level, log(batches) times in all. As all runs
have the same buckets and order, neither join shuffles or sorts a run; only the batch is dealt out and what is written is sorted.
Batches follow from the bytes of text, BATCH_BYTES in each and BATCHES at least. A run's name is
the range of batches it covers and it counts only once its _SUCCESS file exists;
a run covered by a wider one is ignored, so a crash between "write merged run"
and "delete inputs" is harmless.

Defined results: null or empty text is one empty line; a key is the line without
white space at both ends and with A-Z lower-cased; blank keys never count; a line
repeated inside a document counts that document once; repeated rows count as
documents of their own; null doc_ids are kept as they are; empty tables give empty
results; other columns of the input are carried through untouched, but for those named like
the new ones, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from semlake.llm.common import WHITE, ascii_lower, broadcast_within, digest128, materialise, others, remove, scratch, sha256_hex, unused
from semlake.sources import buckets

MIN_DOCS, MIN_CHARS = 10, 1
#: Batches at least and at most (each is a folder of counted keys), and bytes of text in one.
BATCHES, MOST_BATCHES, BATCH_BYTES = 4, 64, 128 << 20
RUN = StructType().add("a", LongType()).add("b", LongType()).add("n", LongType())


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_keys(text: Column) -> Column:
    """The keys of a text's lines. Lower-casing the whole text first is the same: it keeps \\n."""
    return F.transform(lines_of(ascii_lower(F.coalesce(text, F.lit("")))), lambda x: F.btrim(x, F.lit(WHITE)))


def _hash(key: Column) -> Column:
    """Null for keys under MIN_CHARS code points, which never count."""
    return F.when(F.length(key) >= MIN_CHARS, digest128(key))


def key_counts(docs: DataFrame, *by: Column) -> DataFrame:
    """(by.., a, b, n): documents per line key, combined before the shuffle."""
    held = docs.select(*by, F.explode(F.array_distinct(F.transform(line_keys(F.col("text")), _hash))).alias("h"))
    names = held.columns[:-1]
    return held.where("h is not null").select(*names, "h.a", "h.b").groupBy(*names, "a", "b").agg(F.count("*").alias("n"))


class LineRuns:
    def __init__(self, spark: SparkSession, path: str, min_docs: int = MIN_DOCS, buckets_: int | None = None):
        self.spark, self.path, self.min_docs = spark, path, min_docs
        self.buckets = buckets_ or buckets.bucket_count(spark)

    def runs(self) -> list[tuple[int, int, int, str]]:
        """(level, first batch, last batch, folder) of the complete runs that no other run covers."""
        jvm = self.spark._jvm.org.apache.hadoop.fs
        root = jvm.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = []
        for s in fs.listStatus(root) if fs.exists(root) else []:
            if fs.exists(jvm.Path(s.getPath(), "_SUCCESS")):
                name = s.getPath().getName()
                found.append((*map(int, name.split("-")), f"{self.path}/{name}"))
        return sorted(r for r in found if not any(o is not r and o[0] > r[0] and o[1] <= r[1] and r[2] <= o[2] for o in found))

    def read(self, run: tuple) -> DataFrame:
        return buckets.read(self.spark, run[3], RUN, ["a", "b"], self.buckets)

    def known(self, run: tuple) -> DataFrame:
        """The keys that a run alone shows to be frequent."""
        return self.read(run).where(F.col("n") >= self.min_docs).select("a", "b")

    def _write(self, counts: DataFrame, level: int, first: int, last: int, aligned: bool = False) -> None:
        buckets.write(counts.select("a", "b", "n"), f"{self.path}/{level}-{first}-{last}", ["a", "b"], self.buckets, aligned)

    def without_known(self, counts: DataFrame) -> DataFrame:
        """Merge-anti-join of a batch with the runs."""
        for run in self.runs():
            counts = counts.join(self.known(run).hint("merge"), ["a", "b"], "left_anti")
        return counts

    def merged(self, one: tuple, two: tuple) -> DataFrame:
        """Two runs by a full merge join."""
        both = self.read(one).withColumnRenamed("n", "m").join(self.read(two).hint("merge"), ["a", "b"], "full")
        return both.select("a", "b", (F.coalesce("m", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("n"))

    def add(self, counts: DataFrame) -> None:
        """Add the key counts of one batch of documents."""
        batch = max((r[2] for r in self.runs()), default=-1) + 1
        self._write(self.without_known(counts), 0, batch, batch)
        level = 0
        while len(due := [r for r in self.runs() if r[0] == level]) >= 2:
            self._merge(*due[:2], level + 1)
            level += 1

    def _merge(self, one: tuple, two: tuple, level: int) -> None:
        self._write(self.merged(one, two), level, min(one[1], two[1]), max(one[2], two[2]), aligned=True)
        for run in (one, two):
            buckets.forget(self.spark, run[3])
            remove(self.spark, run[3])

    def drop(self) -> None:
        """Forget and delete the runs."""
        for run in self.runs():
            buckets.forget(self.spark, run[3])
        remove(self.spark, self.path)

    def frequent(self) -> DataFrame:
        """The frequent keys of all batches; what is left of the levels is merged into one run first, the newest first."""
        while len(runs := self.runs()) > 1:
            by_age = sorted(runs, key=lambda r: -r[1])
            self._merge(by_age[1], by_age[0], max(by_age[0][0], by_age[1][0]) + 1)
        if not runs:
            return self.spark.createDataFrame([], "a bigint, b bigint")
        return self.known(runs[0])


def batches_of(docs: DataFrame) -> int:
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(BATCHES, min(MOST_BATCHES, -(-size // BATCH_BYTES)))


def frequent_lines(docs: DataFrame, min_docs: int = MIN_DOCS, batches: int | None = None, path: str | None = None) -> DataFrame:
    """Hashes (a, b) of the line keys found in at least ``min_docs`` documents.

    The documents are counted in one scan, dealt into batches by a hash of their
    text; the batches then enter the runs one after another."""
    spark = docs.sparkSession
    path = path or scratch(spark)
    batches = batches or batches_of(docs)
    batch = F.pmod(F.xxhash64("text"), F.lit(batches)).cast("int").alias("batch")
    key_counts(docs, batch).write.partitionBy("batch").parquet(f"{path}/counted")
    counted = spark.read.schema("a bigint, b bigint, n bigint, batch int").parquet(f"{path}/counted")
    index = LineRuns(spark, f"{path}/runs", min_docs)
    for i in range(batches):
        index.add(counted.where(F.col("batch") == i).drop("batch"))
    return index.frequent()


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, batches: int | None = None) -> DataFrame:
    """The documents with the columns ll_lines (lines before), ll_dropped and ll_text (the rest)."""
    path = scratch(docs.sparkSession)
    frequent = materialise(frequent_lines(docs, min_docs, batches, path), f"{path}/frequent")
    remove(docs.sparkSession, f"{path}/counted")
    LineRuns(docs.sparkSession, f"{path}/runs").drop()
    rows = frequent.count()
    # One row per distinct text that loses lines, with their positions: copies meet here once.
    spot = docs.select(digest128(F.coalesce("text", F.lit(""))).alias("t"), F.posexplode(F.transform(line_keys(F.col("text")), _hash)).alias("pos", "h"))
    spot = spot.where("h is not null").select(F.col("t.a").alias("ll_ta"), F.col("t.b").alias("ll_tb"), "pos", "h.a", "h.b")
    spot = spot.join(broadcast_within(frequent, rows * 64), ["a", "b"], "left_semi")
    spot = materialise(spot.groupBy("ll_ta", "ll_tb").agg(F.collect_set("pos").alias("ll_pos")), f"{path}/spots")
    remove(docs.sparkSession, f"{path}/frequent")
    held = spot.agg(F.coalesce(F.sum(F.size("ll_pos") * 8 + 64), F.lit(0))).first()[0]
    text = F.coalesce("text", F.lit(""))
    new = ["ll_lines", "ll_dropped", "ll_text"]
    t, every, ta, tb, at = unused(docs, "ll_t", "ll_all", "ll_ta", "ll_tb", "ll_pos")
    out = docs.withColumns({t: digest128(text), every: lines_of(F.col("text"))})
    spot = spot.toDF(ta, tb, at)
    out = out.join(broadcast_within(spot, held), (F.col(f"{t}.a") == F.col(ta)) & (F.col(f"{t}.b") == F.col(tb)), "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size(every) - 1), F.col(at))
    kept = F.when(F.col(at).isNull(), text).otherwise(F.array_join(F.transform(stay, lambda i: F.get(every, i)), "\n"))
    return out.select(
        *others(docs, new),
        F.size(every).cast("long").alias("ll_lines"),
        F.coalesce(F.size(at), F.lit(0)).cast("long").alias("ll_dropped"),
        kept.alias("ll_text"),
    )


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", F.col("ll_lines").alias("n_lines"), F.col("ll_dropped").alias("n_dropped"), sha256_hex(F.col("ll_text")).alias("kept_sha256"))


OP4_SQL = r"""
WITH l AS (
  SELECT d, doc_id, i, s, translate(trim(s, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT d, doc_id, unnest(ls) AS s, unnest(range(len(ls))) AS i
        FROM (SELECT row_number() OVER () AS d, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
f AS (SELECT k FROM l WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT d) >= 10)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(f.k) AS n_dropped,
       sha256(coalesce(string_agg(s, chr(10) ORDER BY i) FILTER (WHERE f.k IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN f ON l.k = f.k GROUP BY d
"""
