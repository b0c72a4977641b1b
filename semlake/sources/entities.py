"""Enumerations of entities: by module, facts with indices, dynamic members, words in sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semlake.functions import text

# Keywords before a stated goal.
GOAL_KEYWORDS = ("lemma", "theorem", "proposition", "corollary", "schematic_goal")


def declared_in(entities: DataFrame, module: str, kind: int | None = None) -> DataFrame:
    out = entities.where(F.col("module") == module)
    return out if kind is None else out.where(F.col("kind") == kind)


def facts(df: DataFrame, name: str, theorems: str) -> DataFrame:
    """(name, index, theorem): index 0 for a single theorem, else from 1."""
    out = df.select(name, F.size(theorems).alias("n"), F.posexplode(theorems).alias("pos", "theorem"))
    return out.select(name, F.when(F.col("n") == 1, 0).otherwise(F.col("pos") + 1).alias("index"), "theorem")


def by_module(entities: DataFrame) -> DataFrame:
    """Names of each module and kind in one pass; counts, with the names as sorted lists per kind."""
    return entities.groupBy("module", "kind").agg(F.array_sort(F.collect_list("name")).alias("names"), F.count("*").alias("n"))


def new_members(current: DataFrame, parents: DataFrame) -> DataFrame:
    """(collection, key): members of dynamic collections that no parent module has, each once."""
    on = ["collection", "key"]
    return current.join(parents.select(*on), on, "left_anti").dropDuplicates(on)


def session_sources(sessions: DataFrame, ending: str = ".thy") -> DataFrame:
    """Name and digest of source files; two columns are read and the ending is tested in the scan."""
    return sessions.select("name", "digest").where(F.col("name").endswith(ending))


def name_offsets(sources: DataFrame, names: DataFrame) -> DataFrame:
    """(source, name, word_off, goal_off): first place of each name's base as a word and after a goal keyword, or -1.

    sources (source, content); names (source, name). Words are found once per source; an offset is the length of what
    stands before, by a running sum over the parts between the words."""
    words = F.regexp_extract_all("content", F.lit(r"(\w+(?:\.\w+)*)"), F.lit(1))
    gaps = F.split("content", r"\w+(?:\.\w+)*", -1)
    each = sources.select("source", F.posexplode(F.arrays_zip(gaps.alias("gap"), words.alias("word"))).alias("i", "x"))
    each = each.select("source", "i", F.length("x.gap").alias("g"), F.col("x.word").alias("word"))
    from pyspark.sql import Window as W

    order = W.partitionBy("source").orderBy("i")
    before = F.coalesce(F.sum(F.col("g") + F.length("word")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    each = each.where("word is not null").withColumn("off", before + F.col("g"))
    each = each.withColumns({"last": F.lag("word").over(order), "last_off": F.lag("off").over(order), "gap": F.col("g")})
    first = each.groupBy("source", "word").agg(F.min("off").alias("word_off"), F.min(F.when(F.col("last").isin(*GOAL_KEYWORDS), F.col("last_off"))).alias("goal_off"))
    base = F.regexp_replace(text.base_name(F.col("name")), r"\([0-9]+\)$", "")
    out = names.withColumn("word", base).join(first, ["source", "word"], "left")
    return out.select("source", "name", F.coalesce("word_off", F.lit(-1)).alias("word_off"), F.coalesce("goal_off", F.lit(-1)).alias("goal_off"))
