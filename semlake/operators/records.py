"""Mutations of keyed tables as whole-table rewrites: each returns the new table; sources.store swaps it in."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semlake.functions import keys, q15
from semlake.operators import filters
from semlake.operators.common import small
from semlake.schemas import EXPERIENCE


def get(df: DataFrame, key: bytes) -> DataFrame:
    """The row of a key; the predicate reaches the Parquet scan."""
    return df.where(F.col("key") == F.lit(key))


def get_many(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows aligned with wanted (pos, key); columns are null where a key is missing."""
    # A left join can't broadcast its left side: the few rows that are wanted are fetched first, and then aligned.
    found = df.join(small(wanted.select("key").distinct()), "key", "left_semi")
    return wanted.join(small(found), "key", "left").orderBy("pos")


def contains(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted with ``present``."""
    held = df.select("key", F.lit(True).alias("present")).distinct()
    return wanted.join(held, "key", "left").withColumn("present", F.coalesce("present", F.lit(False)))


def entities(df: DataFrame) -> DataFrame:
    return df.where(~keys.is_module(F.col("key")))


def of_key_kind(df: DataFrame, kind: int) -> DataFrame:
    """By the tag in the key, without looking at values."""
    return df.where((F.length("key") == keys.XOR_LENGTH) & (keys.kind_tag(F.col("key")) == kind))


def with_prefix(df: DataFrame, prefix: bytes) -> DataFrame:
    return df.where(keys.prefix(F.col("key")) == F.lit(prefix))


def embed_candidates(df: DataFrame, kinds: Sequence[int] | None = None) -> DataFrame:
    """Interpreted records, also those in progress; with kinds only these."""
    out = df.where(F.col("interpretation").isNotNull())
    return out if kinds is None else out.where(F.col("kind").isin(list(kinds)))


def upsert(df: DataFrame, new: DataFrame, on: Sequence[str] = ("key",)) -> DataFrame:
    on = list(on)
    return df.join(new.select(*on), on, "left_anti").unionByName(new)


def delete(df: DataFrame, gone: DataFrame, on: Sequence[str] = ("key",)) -> DataFrame:
    return df.join(gone.select(*on), list(on), "left_anti")


def update_field(df: DataFrame, new: DataFrame, field: str) -> DataFrame:
    """Set a field where new has the key; keys that are not there stay absent."""
    fresh = new.select("key", F.col(field).alias("_new"), F.lit(True).alias("_hit"))
    out = df.join(fresh, "key", "left")
    return out.withColumn(field, F.when(F.col("_hit"), F.col("_new")).otherwise(F.col(field))).select(df.columns)


def mark_interpreted(status: DataFrame, done: DataFrame) -> DataFrame:
    """finished for the modules in done, with zero counters where there was no row; modules in progress are skipped."""
    done = done.select("key").where(~keys.is_wip(F.col("key"))).distinct()
    both = status.withColumn("_old", F.lit(True)).join(done.withColumn("_done", F.lit(True)), "key", "full")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("input_tokens", "cache_creation_tokens", "cache_read_tokens", "output_tokens", "cost_usd")}
    out = {c: F.when(F.col("_old"), F.col(c)).otherwise(z) for c, z in zero.items()}
    return both.withColumns(out | {"finished": F.coalesce(F.col("_done"), F.col("finished"))}).select(status.columns)


def mark_embedded(status: DataFrame, done: DataFrame) -> DataFrame:
    """done (model, key, tokens): finished, and the tokens added where positive."""
    new = done.select("model", "key", F.lit(True).alias("finished"), F.greatest("tokens", F.lit(0)).cast("bigint").alias("total_tokens"))
    return status.unionByName(new).groupBy("model", "key").agg(F.bool_or("finished").alias("finished"), F.sum("total_tokens").alias("total_tokens"))


def add_costs(ledger: DataFrame, deltas: DataFrame) -> DataFrame:
    """Old totals and deltas by key: counters add up, finished stays, the model of the last delta wins.

    ledger: as module_status; deltas: the same columns but finished, and ts."""
    counters = ["input_tokens", "cache_creation_tokens", "cache_read_tokens", "output_tokens", "cost_usd"]
    old = ledger.select("key", *counters, "finished", "model", F.lit(None).cast("timestamp").alias("ts"))
    new = deltas.select("key", *counters, F.lit(None).cast("boolean").alias("finished"), "model", "ts")
    return (
        old.unionByName(new).groupBy("key")
        .agg(*[F.sum(c).alias(c) for c in counters], F.coalesce(F.bool_or("finished"), F.lit(False)).alias("finished"), F.max_by("model", F.coalesce("ts", F.lit("0001-01-01").cast("timestamp"))).alias("model"))
    )


def fold_costs(rows: DataFrame) -> DataFrame:
    """Ledger rows and deltas (finished and ts may be missing) as one row a key, which may be folded again: counters add up,
    finished stays, the model of the last ts wins."""
    counters = ("input_tokens", "cache_creation_tokens", "cache_read_tokens", "output_tokens", "cost_usd")
    finished = F.coalesce(F.bool_or("finished"), F.lit(False)) if "finished" in rows.columns else F.lit(False)
    at = F.coalesce("ts", F.lit("0001-01-01").cast("timestamp"))
    folded = {c: F.sum(c) for c in counters} | {"finished": finished, "model": F.max_by("model", at), "ts": F.max("ts")}
    out = rows.groupBy("key").agg(*(f.alias(c) for c, f in folded.items()))
    return out.select(*(c if c in out.columns else F.lit(None).alias(c) for c in rows.columns))


def added_costs(a: str, b: str, columns: Sequence[str]) -> list:
    """The columns of two folded ledger rows (structs, either may be null) added up."""
    later = F.coalesce(F.col(f"{b}.ts") >= F.col(f"{a}.ts"), F.col(f"{b}.ts").isNotNull() | F.col(a).isNull())
    named = {
        "finished": F.coalesce(F.col(f"{a}.finished"), F.lit(False)) | F.coalesce(F.col(f"{b}.finished"), F.lit(False)),
        "model": F.when(later, F.coalesce(F.col(f"{b}.model"), F.col(f"{a}.model"))).otherwise(F.coalesce(F.col(f"{a}.model"), F.col(f"{b}.model"))),
        "ts": F.greatest(f"{a}.ts", f"{b}.ts"),
    }
    return [named.get(c, F.coalesce(F.col(f"{a}.{c}"), F.lit(0)) + F.coalesce(F.col(f"{b}.{c}"), F.lit(0))).alias(c) for c in columns]


def clean_wip(df: DataFrame) -> DataFrame:
    return df.where(~keys.is_wip(F.col("key")))


def belonging(records: DataFrame, modules: Sequence[bytes]) -> DataFrame:
    """Keys of the records that belong to the modules, by prefix or constituent."""
    return records.where(F.coalesce(filters.belongs_to(F.col("key"), F.col("kind"), F.col("constituents"), modules), F.lit(False))).select("key")


def remove_modules(records: DataFrame, vectors: DataFrame, modules: Sequence[bytes]) -> tuple[DataFrame, DataFrame]:
    gone = belonging(records, modules)
    return delete(records, gone), delete(vectors, gone)


def purge_kind(vectors: DataFrame, kind: int = EXPERIENCE) -> DataFrame:
    """All vectors but those whose key carries the tag, in every model."""
    return vectors.where(~((F.length("key") == keys.XOR_LENGTH) & (keys.kind_tag(F.col("key")) == kind)))


def copy_prefix(df: DataFrame, old: bytes, new: bytes) -> DataFrame:
    """Rows of the old prefix once more under the new one; XOR keys are skipped, old rows stay."""
    moved = df.where((keys.prefix(F.col("key")) == F.lit(old)) & (F.length("key") != keys.XOR_LENGTH))
    return upsert(df, moved.withColumn("key", keys.with_prefix(F.col("key"), F.lit(new))))


def rekey_constituent(records: DataFrame, old: bytes, new: bytes, indexed: DataFrame | None = None) -> DataFrame:
    """(old_key, ..record under its new key) of the records that mention the old hash: the hash is
    swapped and the XOR prefix computed again. With the index (hash, key) only records listed there under the old hash are taken, and one of
    them without constituents raises an error; without it such records mention nothing."""
    holds = F.exists("constituents", lambda c: c["hash"] == F.lit(old))
    if indexed is not None:
        # The test below needs a column of the index, else it is made before the join, on records that are not listed.
        listed = indexed.where(F.col("hash") == F.lit(old)).select("key", F.col("hash").alias("_listed")).distinct()
        records = records.join(small(listed), "key")
        legacy = F.raise_error(F.concat(F.lit("a record has no constituents, migrate it first: "), F.hex("key"))).cast("boolean")
        holds = F.when((F.col("_listed") == F.lit(old)) & F.col("constituents").isNull(), legacy).otherwise(holds)
    mentions = records.where(holds).drop("_listed")
    swap = F.transform("constituents", lambda c: F.struct(c["name"].alias("name"), F.when(c["hash"] == F.lit(old), F.lit(new)).otherwise(c["hash"]).alias("hash")))
    out = mentions.withColumn("old_key", F.col("key")).withColumn("constituents", swap)
    prefix = keys.xor_prefix(F.transform("constituents", lambda c: c["hash"]))
    return out.withColumn("key", keys.with_prefix(F.col("key"), prefix))


def migration_source(names: DataFrame, status: DataFrame, new: bytes) -> DataFrame:
    """The newest finished other version (hash, name, ts) of the module with the new hash."""
    mine = names.where(F.col("hash") == F.lit(new)).select("name")
    finished = status.where("finished").select(F.col("key").alias("hash"))
    other = names.where(F.col("hash") != F.lit(new)).join(F.broadcast(mine), "name", "left_semi").join(finished, "hash", "left_semi")
    return other.orderBy(F.desc("ts"), "hash").limit(1)


def migrated(records: DataFrame, vectors: dict[str, DataFrame], old: bytes, new: bytes) -> dict[str, DataFrame]:
    """Records and vector tables after a module's hash has changed: its plain records are there under the new prefix too, and records
    that mention the old hash stand under their new key only. A vector goes where its record goes."""
    rekeyed = rekey_constituent(records, old, new)
    moves = rekeyed.select(F.col("old_key").alias("key"), F.col("key").alias("new_key"))
    kept = delete(records, moves)
    out = {"records": upsert(copy_prefix(kept, old, new), rekeyed.drop("old_key"))}
    for name, df in vectors.items():
        moved = df.join(small(moves), "key").withColumn("key", F.col("new_key")).select(df.columns)
        out[name] = upsert(copy_prefix(delete(df, moves), old, new), moved)
    return out


def put_experiences(records: DataFrame, vectors: DataFrame, new: DataFrame, new_vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vectors are checked first: every new experience needs one, else nothing is written."""
    if (row := new.join(new_vectors.select("key"), "key", "left_anti").select("key").first()) is not None:
        raise ValueError(f"no document text, so no vector, for experience {bytes(row[0]).hex()}")
    return upsert(records, new), upsert(vectors, new_vectors, ("model", "key"))


def delete_experiences(records: DataFrame, vectors: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From all models, and the record; deleting again changes nothing. The index is derived from records."""
    return delete(records, gone), delete(vectors, gone)


def unpack_patterns(records: DataFrame) -> DataFrame:
    """Legacy experiences keep their patterns as JSON in expr: move them to goal_patterns; corrupt ones stay null."""
    legacy = (F.col("kind") == EXPERIENCE) & F.col("goal_patterns").isNull()
    parsed = F.from_json("expr", "array<string>")
    ok = legacy & parsed.isNotNull()
    return records.withColumns({"goal_patterns": F.when(ok, parsed).otherwise(F.col("goal_patterns")), "expr": F.when(ok, None).otherwise(F.col("expr"))})


def purge_xor_kinds(df: DataFrame, kinds: Sequence[int]) -> DataFrame:
    return df.where(~((F.length("key") == keys.XOR_LENGTH) & keys.kind_tag(F.col("key")).isin(list(kinds))))


def migrate_float32(raw: DataFrame, dimension: int) -> tuple[DataFrame, DataFrame]:
    """(vectors in the 16-bit format, counts by state) of a raw store (model, key, value binary): by byte length a value is
    migrated already, float32 to be quantized, or wrong and left out."""
    state = raw.withColumn("state", filters.right_length(F.col("value"), dimension))

    @F.pandas_udf("array<double>")
    def decode(value: pd.Series) -> pd.Series:
        kind = {2 * dimension: "<i2", 4 * dimension: "<f4"}
        return value.map(lambda b: np.frombuffer(b, kind[len(b)]).astype(float).tolist())

    good = state.where(F.col("state") != "wrong").withColumn("v", decode("value"))
    q = F.when(F.col("state") == "unmigrated", q15.quantize(F.col("v"))).otherwise(F.transform("v", lambda x: x.cast("int")))
    out = good.select("model", "key", F.transform(q, lambda x: x.cast("smallint")).alias("q"))
    return out, state.groupBy("state").agg(F.count("*").alias("n"))


def split_cached(entries: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cached, uncached, stale) entries of a file: described already, to be described, and described under another expr."""
    held = records.where(F.col("interpretation").isNotNull()).select("key", F.col("expr").alias("stored_expr"), F.lit(True).alias("_held"))
    both = entries.join(held, "key", "left")
    cached = both.where("_held")
    stale = cached.where(~F.col("expr").eqNullSafe(F.col("stored_expr")))
    return cached.drop("_held", "stored_expr"), both.where(F.col("_held").isNull()).drop("_held", "stored_expr"), stale.drop("_held", "stored_expr")


def unanswered(entries: DataFrame, answers: DataFrame) -> DataFrame:
    """Entries without an answer; a file is complete when there are none."""
    return entries.join(answers.where(F.col("interpretation").isNotNull()).select("key"), "key", "left_anti")
