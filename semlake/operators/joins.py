"""Joins that dictionary lookups stand for: spans, identifiers, replayed entries, names in stages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def span_at(positions: DataFrame, spans: DataFrame, by: str, offset: str = "off", start: str = "start", end: str = "end", bin_size: int = 4096) -> DataFrame:
    """positions with the span (start <= off < end) they lie in, null if none. Both sides meet on (by, bin):
    a span is repeated for each bin that it touches, so there is no nested loop."""
    p = positions.withColumn("_bin", F.floor(F.col(offset) / bin_size))
    # The rows of a span over very many bins are made by explode, next to the bins they are for.
    s = spans.where(F.col(end) > F.col(start)).withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / bin_size), F.floor((F.col(end) - 1) / bin_size))))
    s = s.withColumnRenamed(by, "_by").withColumnRenamed("_bin", "_sbin")
    return p.join(s, (F.col(by) == F.col("_by")) & (F.col("_bin") == F.col("_sbin")) & (F.col(start) <= F.col(offset)) & (F.col(offset) < F.col(end)), "left").drop("_bin", "_by", "_sbin")


def resolve_identifiers(idents: DataFrame, names: DataFrame) -> DataFrame:
    """(ident, hash, state): by exact name, else by a prefix of the hex hash; found, none or ambiguous.

    names (name, hash). The prefix join is an equi-join for each prefix length that occurs."""
    exact = idents.join(names, idents["ident"] == names["name"]).select("ident", "hash")
    left = idents.where(F.col("ident").rlike("^[0-9a-fA-F]+$")).join(exact.select("ident"), "ident", "left_anti")
    hexed = names.select("hash", F.lower(F.hex("hash")).alias("h"))
    lengths = [r[0] for r in left.select(F.length("ident")).distinct().limit(65).collect()]
    found = exact
    for n in lengths:
        at = left.where(F.length("ident") == n).withColumn("p", F.lower("ident"))
        found = found.unionByName(at.join(hexed.withColumn("p", F.substring("h", 1, n)), "p").select("ident", "hash"))
    counted = found.groupBy("ident").agg(F.count_distinct("hash").alias("n"), F.min("hash").alias("hash"))
    out = idents.join(counted, "ident", "left")
    state = F.when(F.col("n").isNull(), "none").when(F.col("n") > 1, "ambiguous").otherwise("found")
    return out.select("ident", F.when(F.col("n") == 1, F.col("hash")).alias("hash"), state.alias("state"))


def replayed(entries: DataFrame, replay: DataFrame) -> DataFrame:
    """Entries (name, digest) matched with replayed facts (template, suffix, digest) by digest; those whose name ends
    in the suffix come first; an entry is dropped when no match of its digest is confirmed by a name."""
    both = entries.join(replay, "digest").withColumn("confirmed", F.col("name").endswith(F.col("suffix")).cast("int"))
    any_ = both.where("confirmed = 1").select("digest").distinct()
    both = both.join(any_, "digest", "left_semi")
    order = W.partitionBy("name").orderBy(F.desc("confirmed"), F.desc(F.length("suffix")), "template")
    return both.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def staged_lookup(wanted: DataFrame, by_key: DataFrame, by_base: DataFrame) -> DataFrame:
    """(name, target, stage): by the exact name, else by the base name if it is the only one with it."""
    base = by_base.groupBy("base").agg(F.min("target").alias("b_target"), F.count("*").alias("n")).where("n = 1")
    out = wanted.join(by_key.select("name", F.col("target").alias("k_target")), "name", "left")
    out = out.join(base.select(F.col("base").alias("name"), "b_target"), "name", "left")
    return out.select("name", F.coalesce("k_target", "b_target").alias("target"), F.when(F.col("k_target").isNotNull(), "exact").when(F.col("b_target").isNotNull(), "base").otherwise("none").alias("stage"))


def explain_constants(terms: DataFrame, records: DataFrame, seen: DataFrame) -> DataFrame:
    """Constants of terms (pos, consts) with their interpretation, each once, in order, without those seen before."""
    each = terms.select("pos", F.posexplode("consts").alias("i", "const")).groupBy("const").agg(F.min(F.struct("pos", "i")).alias("at"))
    return each.join(seen.select("const"), "const", "left_anti").join(records.select(F.col("name").alias("const"), "interpretation"), "const").where("interpretation is not null").orderBy("at").drop("at")


def own_definitions(entities: DataFrame, axioms: DataFrame) -> DataFrame:
    """Entities with the axioms that define them in their own module."""
    return entities.join(axioms, ["name", "module"])
