"""Ordered logic: dedup by order or priority, batches, running budgets, comparison with the row before, fusion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from semlake.operators.common import checkpoint_path, cut, small

DECAY = 0.62
#: Rows of a group that one task sorts and sums.
GROUP_ROWS = 500_000


def keep_first(df: DataFrame, key: str | list[str], *order) -> DataFrame:
    """The first row of each key. Tasks cut each key to one row before the shuffle."""
    w = W.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def keep_best_entry(df: DataFrame, key: str) -> DataFrame:
    """A goal offset (>= 0) beats none; the least goal offset, else the least word offset; then input order."""
    goal = F.col("goal_off") >= 0
    return keep_first(df, key, F.desc(goal), F.when(goal, F.col("goal_off")), F.when(~goal, F.col("word_off")), "input_pos")


def dedup_against(new: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    return new.join(existing.select(key), key, "left_anti")


def newest(df: DataFrame, name: str, value: str, ts: str, where: Column) -> DataFrame:
    """The newest value of each name among the rows that qualify."""
    return df.where(where).groupBy(name).agg(F.max_by(value, ts).alias(value), F.max(ts).alias(ts))


def _running(df: DataFrame, value: Column, by: list[str], order: tuple, out: str) -> DataFrame:
    """The running sum of value within each group, in order. Where a group has more than GROUP_ROWS rows, rows are dealt into ranges of
    (group, order), each range sums its own part of a group, and the sums of the parts before it are added."""
    spark = df.sparkSession
    largest = df.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if largest <= GROUP_ROWS:
        return df.withColumn(out, F.sum(value).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = df.withColumn("_value", value).repartitionByRange(ranges, *by, *order).withColumn("_part", F.spark_partition_id())
    laid = cut(laid, checkpoint_path(spark))  # written, so that rows keep their ranges
    parts = laid.groupBy(*by, "_part").agg(F.sum("_value").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_part").alias("_at"), before.alias("_before"))
    same = F.col("_part") == F.col("_at")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    own = F.sum("_value").over(W.partitionBy(*by, "_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return laid.join(small(parts), same).withColumn(out, own + F.col("_before")).select(*df.columns, out)


def batches(df: DataFrame, size: int, by: str | list[str], *order) -> DataFrame:
    """Batch numbers from 0 within each group."""
    out = _running(df, F.lit(1), [by] if isinstance(by, str) else by, order, "batch")
    return out.withColumn("batch", F.floor((F.col("batch") - 1) / size))


def within_budget(df: DataFrame, cost: str, limit: int, by: str | list[str], *order) -> DataFrame:
    """The leading rows of each group while their running cost is within the limit."""
    return _running(df, F.col(cost), [by] if isinstance(by, str) else by, order, "spent").where(F.col("spent") <= limit)


def trim_context(df: DataFrame, key: str, context: str, statement: str, tokens, limit: int, for_goal: bool = True) -> DataFrame:
    """Segments of a context (parted by two blank lines) taken in order while they fit with the statement,
    then sorted by class and put before the statement. tokens: Column -> Column counts them."""
    seg = df.select(key, statement, F.posexplode_outer(F.split(context, "\n\n\n")).alias("pos", "seg"))
    ok = F.coalesce(F.col("seg"), F.lit("")) != ""
    if not for_goal:
        ok = ok & ~F.col("seg").startswith("theory ")
    seg = seg.withColumn("part", F.when(ok, F.concat("seg", F.lit("\n\n"))))
    w = W.partitionBy(key).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    seg = seg.withColumn("spent", F.sum(F.coalesce(tokens(F.col("part")), F.lit(0))).over(w) + tokens(F.col(statement)))
    rank = F.when(F.col("part").startswith("theory "), -1).when(F.col("part").startswith("notation "), 0).when(F.col("part").startswith("class "), 1).when(F.col("part").startswith("fact "), 3).otherwise(2)
    taken = F.sort_array(F.collect_list(F.when((F.col("spent") <= limit) & F.col("part").isNotNull(), F.struct(rank.alias("r"), "pos", "part"))))
    out = seg.groupBy(key).agg(taken.alias("taken"), F.first(statement).alias(statement))
    return out.select(key, F.concat(F.array_join(F.transform("taken", lambda x: x.part), ""), statement).alias("text"))


def collapse_repeats(df: DataFrame, by: str | list[str], order: list, head: str, locale: str, same: str) -> DataFrame:
    """Replace the head line, and drop the locale line, where both equal those of the row before as they were."""
    w = W.partitionBy(*([by] if isinstance(by, str) else by)).orderBy(*order)
    again = F.col(head).isNotNull() & F.col(locale).isNotNull() & (F.lag(head).over(w) == F.col(head)) & (F.lag(locale).over(w) == F.col(locale))
    again = F.coalesce(again, F.lit(False))
    return df.withColumn("_again", again).withColumns({head: F.when(F.col("_again"), F.lit(same)).otherwise(F.col(head)), locale: F.when(~F.col("_again"), F.col(locale))}).drop("_again")


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that are not unique, with their counts."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    if (row := duplicates(df, keys).first()) is not None:
        raise ValueError(f"not unique: {row.asDict()}")
    return df


def rank_weight(rank: Column) -> Column:
    """0.62 ** log2(rank + 1), rank from 0."""
    return F.pow(F.lit(DECAY), F.log2(rank + 1))


def mesh(lists: list[tuple[float, DataFrame]], key: str, k: int, forced: DataFrame | None = None) -> DataFrame:
    """Weighted fusion of scored lists (key, score): each list is divided by its mean score and weighted; a key's
    total is the sum of its parts; forced keys come first. Ties go to the lesser key."""
    mean = lambda df: df.agg(F.avg("score")).first()[0] or 1.0
    parts = [df.select(key, (F.col("score") * F.lit(weight / mean(df))).alias("part")) for weight, df in lists]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    total = both.groupBy(key).agg(F.sum("part").alias("score")).withColumn("forced", F.lit(0))
    if forced is not None:
        total = total.join(forced.select(key), key, "left_anti").unionByName(forced.select(key, F.lit(None).cast("double").alias("score"), F.lit(1).alias("forced")))
    return total.orderBy(F.desc("forced"), F.desc("score"), key).limit(k)


def best_answers(answers: DataFrame, known: DataFrame, label: str, seq: str, answer: str) -> DataFrame:
    """The last answer of each known label; unknown labels are left out (see unknown_labels)."""
    return answers.join(known.select(label), label, "left_semi").groupBy(label).agg(F.max_by(answer, seq).alias(answer))


def unknown_labels(answers: DataFrame, known: DataFrame, label: str) -> DataFrame:
    return answers.select(label).distinct().join(known.select(label), label, "left_anti")
