"""Maintenance commands over a store: list, remove, reindex, fsck, embed, status, push, pull, migrate, clean-wip, keys, compact, prune.

The vectors of a model are a table of their own, ``vectors-<model>``. Every command changes all its tables in one commit."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable
from functools import reduce
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semlake import schemas
from semlake.functions import keys
from semlake.operators import index, joins, records, report, snapshot
from semlake.providers import PROVIDERS, fill_vectors
from semlake.session import session
from semlake.sources.archive import Remote
from semlake.sources.store import Change, Store, dump_keys

PLAIN = {"records": schemas.RECORDS, "module_status": schemas.MODULE_STATUS, "module_names": schemas.MODULE_NAMES}


def vector_table(model: str) -> str:
    return "vectors-" + quote(model, safe="")


def models(store: Store) -> list[str]:
    """From the names of the tables, without a scan."""
    return sorted(unquote(t[8:]) for t in store.tables() if t.startswith("vectors-"))


def vectors(store: Store) -> DataFrame:
    held = [store.read(vector_table(m)) for m in models(store)]
    return reduce(DataFrame.unionByName, held) if held else store.spark.createDataFrame([], schemas.VECTORS)


def tables(store: Store) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    return (store.read("records", schemas.RECORDS), vectors(store), store.read("module_status", schemas.MODULE_STATUS), store.read("module_names", schemas.MODULE_NAMES))


def on_vectors(store: Store, change: Change, do: Callable[[DataFrame], DataFrame]) -> None:
    """Replace each model's vectors."""
    for m in models(store):
        change.replace(vector_table(m), do(store.read(vector_table(m))))


def list_(store: Store, args) -> int:
    recs, _, status, names = tables(store)
    rep = report.module_report(recs.where(~keys.is_module(F.col("key"))), status, names)
    rep.select("name", "entities", "finished", "cost_usd", "model").show(args.rows, truncate=False)
    report.totals(rep).show()
    return 0


def remove(store: Store, args) -> int:
    recs, _, status, names = tables(store)
    wanted = joins.resolve_identifiers(store.spark.createDataFrame([(i,) for i in args.idents], "ident string"), names.select("name", "hash")).collect()
    bad = [r["ident"] for r in wanted if r["state"] != "found"]
    if bad:
        print("not found or ambiguous: " + ", ".join(bad))
        return 1
    gone = [bytes(r["hash"]) for r in wanted]
    targets = store.spark.createDataFrame([(bytearray(h),) for h in gone], "hash binary")
    report.removal_counts(recs, targets).show(truncate=False)
    if args.yes:
        change = store.change()
        doomed = records.belonging(recs, gone)
        on_vectors(store, change, lambda v: records.delete(v, doomed))
        if store.version("records"):
            change.replace("records", records.delete(recs, doomed))
        if store.version("module_status"):
            change.delete("module_status", targets.withColumnRenamed("hash", "key"))
        change.commit()
    return 0


def fsck(store: Store, args) -> int:
    recs, *_ = tables(store)
    found = index.consistency(recs).first()
    print(found.asDict())
    if found["mismatches"] and args.fix:
        plan = index.repair_plan(recs)
        change = store.change()
        on_vectors(store, change, lambda v: index.repaired(v, plan))
        fixed = index.repaired(recs, plan)
        change.replace("records", fixed)
        change.replace("posting", index.posting(fixed.where(F.col("kind") == schemas.EXPERIENCE)), ("hash",))
        change.commit()
        found = index.consistency(store.read("records")).first()
    return int(found["mismatches"] > 0)


def reindex(store: Store, args) -> int:
    recs, *_ = tables(store)
    store.replace("posting", index.posting(recs.where(F.col("kind") == schemas.EXPERIENCE)), ("hash",))
    return 0


def embed(store: Store, args) -> int:
    """What has no text is listed, the rest is confirmed by ``args.confirm(counts)`` (or --yes), and the tokens of each module are added up."""
    from semlake.api import Searcher

    recs, vecs, _, names = tables(store)
    prov = PROVIDERS[args.provider](schemas.ModelConfig(args.model, args.dimension))
    todo = records.embed_candidates(recs, args.kinds)
    texts = Searcher(recs, vecs, prov).document_texts(todo).join(todo.select("key", "name"), "key")
    for r in texts.where("text is null").orderBy("key").limit(args.rows).collect():
        print(f"no text: {r['name']}")
    counts = report.to_embed(texts, "text").first().asDict()
    print(counts)
    if not (args.yes or getattr(args, "confirm", lambda c: False)(counts)):
        return 0
    new = fill_vectors(texts, vecs, prov, force=args.force)
    done = new.join(texts.select("key", "text"), "key").select(F.lit(args.model).alias("model"), keys.prefix(F.col("key")).alias("key"), F.size(F.split("text", r"\s+")).cast("bigint").alias("tokens"))
    held = store.read("embed_status", schemas.EMBED_STATUS)
    change = store.change().upsert(vector_table(args.model), new)
    change.replace("embed_status", records.mark_embedded(held, done), ("key",)).commit()
    print(f"embedded {new.count()}")
    return 0


def status(store: Store, args) -> int:
    number, held = store.head()
    print(f"commit {number}, pulled {held.get('facts', {}).get('pulled', 0)}")
    for name, entry in sorted(held["tables"].items()):
        print(name, entry["version"], f"{len(entry['deltas'])} deltas")
    if args.path:
        print("remote", Remote(store.spark, args.path).head()[0])
    return 0


def push(store: Store, args) -> int:
    """Refused when the remote is not at the pointer that was pulled last."""
    base = store.head()[1].get("facts", {}).get("pulled", 0)
    held = {t: store.read(t) for t in store.tables() if t in ("records", "module_status", "module_names") or t.startswith("vectors-")}
    dimensions = {unquote(t[8:]): (df.agg(F.max(F.size("q"))).first()[0] or 0) for t, df in held.items() if t.startswith("vectors-")}
    number = Remote(store.spark, args.path).push(held, base, schema_version=schemas.SCHEMA_VERSION, vector_format=schemas.VECTOR_FORMAT, dimensions=dimensions)
    change = store.change()
    change.facts["pulled"] = number
    change.commit()
    print(f"pushed {number}")
    return 0


def pull(store: Store, args) -> int:
    """Members, manifest and vectors are checked before the first write; all tables change together."""
    number, manifest, incoming = Remote(store.spark, args.path).pull()
    snapshot.check_manifest(manifest)
    change = store.change()
    for name, df in sorted(incoming.items()):
        if name.startswith("vectors-"):
            mine = store.read(name) if store.version(name) else None
            here = mine.select(F.size("q")).first() if mine is not None else None
            snapshot.check_vectors(df, here[0] if here else manifest["dimensions"][unquote(name[8:])])
    for name, df in sorted(incoming.items()):
        kind = PLAIN.get(name, schemas.VECTORS)
        mine = store.read(name, kind)
        on = ["hash"] if name == "module_names" else ["key"]
        change.replace(name, snapshot.merge(mine, df.select(mine.columns), on, "finished" if name == "module_status" else None), on)
        print(name, snapshot.statistics(change.read(name)).first().asDict())
        change.replace(name, change.read(name).drop("action"), on)
    change.facts["pulled"] = number
    change.commit()
    return 0


def migrate(store: Store, args) -> int:
    """A module's hash has changed: plain records of its newest finished version are copied under the new prefix, and records that
    mention the old hash are re-keyed with their vectors, all in one commit."""
    recs, _, stat, names = tables(store)
    new = bytes.fromhex(args.hash)
    source = records.migration_source(names, stat, new).first()
    if source is None:
        print("no finished version of the same name")
        return 1
    old = bytes(source["hash"])
    change = store.change()
    for table, moved in records.migrated(recs, {vector_table(m): store.read(vector_table(m)) for m in models(store)}, old, new).items():
        change.replace(table, moved)
    change.replace("posting", index.posting(change.read("records").where(F.col("kind") == schemas.EXPERIENCE)), ("hash",))
    change.commit()
    print(f"migrated from {old.hex()}")
    return 0


def clean_wip(store: Store, args) -> int:
    change = store.change()
    for name in [t for t in ("records", "module_status") if store.version(t)]:
        change.replace(name, records.clean_wip(store.read(name)))
    on_vectors(store, change, records.clean_wip)
    change.commit()
    return 0


def keys_(store: Store, args) -> int:
    dump_keys(vectors(store), args.model, args.path)
    return 0


def compact(store: Store, args) -> int:
    for t, entry in store.tables().items():
        if entry["deltas"]:
            store.compact(t)
    return 0


def prune(store: Store, args) -> int:
    print(f"removed {len(store.prune(args.keep))} folders")
    return 0


def main(argv: list[str] | None = None, spark=None, confirm: Callable[[dict], bool] | None = None) -> int:
    """confirm: asked before texts are embedded, unless --yes is given."""
    parser = argparse.ArgumentParser(prog="semlake")
    parser.add_argument("store")
    sub = parser.add_subparsers(dest="command", required=True)
    commands = {
        "list": list_, "remove": remove, "fsck": fsck, "reindex": reindex, "embed": embed, "status": status, "push": push, "pull": pull,
        "migrate": migrate, "clean-wip": clean_wip, "keys": keys_, "compact": compact, "prune": prune,
    }
    p = {name: sub.add_parser(name) for name in commands}
    for name in ("list", "embed"):
        p[name].add_argument("--rows", type=int, default=50)
    p["remove"].add_argument("idents", nargs="+")
    p["fsck"].add_argument("--fix", action="store_true")
    p["embed"].add_argument("model")
    p["embed"].add_argument("--provider", default="hashing")
    p["embed"].add_argument("--dimension", type=int, default=256)
    p["embed"].add_argument("--kinds", type=int, nargs="*", default=None)
    p["embed"].add_argument("--force", action="store_true")
    for name in ("remove", "embed"):
        p[name].add_argument("--yes", action="store_true")
    p["migrate"].add_argument("hash")
    p["keys"].add_argument("model")
    for name in ("push", "pull", "keys"):
        p[name].add_argument("path")
    p["status"].add_argument("path", nargs="?")
    p["prune"].add_argument("--keep", type=int, default=2)
    args = parser.parse_args(argv)
    if confirm is not None:
        args.confirm = confirm
    return commands[args.command](Store(spark or session(), args.store), args)


if __name__ == "__main__":
    sys.exit(main())
