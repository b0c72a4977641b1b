"""Structural search: an index of path features proposes terms, matching confirms them and gives the bindings."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semlake.functions import terms
from semlake.operators.common import checkpoint_path, cut, ship

#: The feature of every term, for patterns that are one variable.
ANY = ""
#: Terms that are matched before their results are handed on.
ROWS = 1000
#: Shapes of terms whose matches a task remembers, and the most nodes of one.
SHAPES, SHORT = 20_000, 64


def _featured(df: DataFrame, key: str, term: str, pattern: bool) -> DataFrame:
    """(key, feature) of all terms that can be read."""
    ship(df.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = [], []
            for i, text in enumerate(batch.column(term).to_pylist()):
                if (t := terms.parse(text)) is not None:
                    found = [*terms.features(t, pattern), ANY]
                    rows += [i] * len(found)
                    out += found
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(rows, pa.int64())), pa.array(out, pa.string())], names=[key, "feature"])

    return df.select(key, term).mapInArrow(each, f"`{key}` {df.schema[key].dataType.simpleString()}, feature string")


def posting(df: DataFrame, key: str, term: str) -> DataFrame:
    """(key, feature), the index."""
    return _featured(df, key, term, False)


def matches(df: DataFrame, patterns: DataFrame, key: str, term: str, index: DataFrame | None = None) -> DataFrame:
    """(pattern, key, at, bindings) for every node of a term that an instance of a pattern begins at. patterns (pattern bigint, text
    string): a stated set, some thousands at most. With an index, each is looked for among the terms of its rarest feature; as patterns
    go to the index and to the terms, a feature that most terms have moves nothing. Without one, terms are read once and stay where they
    are: a pattern is looked for where a term has the pattern's first node and all of its other ones."""
    spark = df.sparkSession
    if index is None:
        return _matched(df, patterns, key, term)
    path = checkpoint_path(spark)
    wanted = cut(_featured(patterns, "pattern", "text", True), f"{path}/wanted")
    held = index.join(F.broadcast(wanted.select("feature").distinct()), "feature", "left_semi")
    held = cut(held, f"{path}/held")
    counts = held.groupBy("feature").agg(F.count("*").alias("n"))
    ranked = wanted.join(counts, "feature", "left").groupBy("pattern").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "feature")).alias("f"))
    rarest = ranked.where("f.n > 0").select("pattern", F.col("f.feature").alias("feature"))
    proposed = held.join(F.broadcast(rarest), "feature").groupBy(key).agg(F.collect_set("pattern").alias("patterns"))
    return _matched(df.select(key, term).join(proposed, key), patterns, key, term, "patterns")


def _matched(df: DataFrame, patterns: DataFrame, key: str, term: str, proposed: str | None = None) -> DataFrame:
    """Matches of the patterns, or of those only that are proposed (a column of lists), with every term."""
    texts = {r["pattern"]: r["text"] for r in patterns.collect()}
    ship(df.sparkSession)

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = {p: t for p, text in sorted(texts.items()) if (t := terms.parse(text)) is not None}
        fixed = {p: terms.nodes(t, True) for p, t in read.items()}
        # By their first node (None: a variable), so that a term meets only patterns that can begin in it.
        begin: dict[tuple[str, int] | None, list[int]] = {}
        for p, t in read.items():
            free = t.symbols[0][0] == "?" and not t.arity[0]
            begin.setdefault(None if free else (t.symbols[0], t.arity[0]), []).append(p)

        def places(text: str) -> list[tuple[int, int, tuple[tuple[str, int, int], ...]]]:
            """(pattern, node, (variable, first node, one after the last)) of a term's matches."""
            if (t := terms.parse(text)) is None:
                return []
            at: dict[tuple[str, int], list[int]] = {}
            for node, x in enumerate(zip(t.symbols, t.arity, strict=True)):
                at.setdefault(x, []).append(node)
            tried = [(p, range(len(t.symbols))) for p in begin.get(None, ())]
            tried += [(p, some) for x, some in at.items() if x in begin for p in begin[x] if fixed[p] <= at.keys()]
            return [(p, node, tuple((v, *ab) for v, ab in b.items())) for p, some in tried for node in some if (b := terms.bound_at(read[p], t, node)) is not None]

        # Where a pattern matches depends on the nodes that patterns name, and of all others on their arity and on which are the same.
        named = {f"{s}/{n}": (s, n) for x in fixed.values() for s, n in x}
        known: dict[tuple, list] = {}
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                some = batch.column(proposed).to_pylist() if proposed else [None] * batch.num_rows
                rows, which, at, names, values, ends = [], [], [], [], [], [0]
                for i, (text, only) in enumerate(zip(batch.column(term).to_pylist(), some, strict=True)):
                    nodes = [*map(terms.written, (text or "").split())]
                    if None in nodes:
                        continue
                    shape, others = [], {}
                    for x in nodes:
                        if (y := named.get(x) or others.get(x)) is None:
                            y = others[x] = (len(others), x[x.rindex("/") :])
                        shape.append(y)
                    if (found := known.get(shape := tuple(shape))) is None:
                        found = places(text)
                        if len(shape) <= SHORT:
                            if len(known) >= SHAPES:
                                known.clear()
                            known[shape] = found
                    for p, node, bound in found:
                        if only is None or p in only:
                            rows.append(i)
                            which.append(p)
                            at.append(node)
                            for v, a, b in bound:
                                names.append(v)
                                values.append(nodes[a] if b == a + 1 else " ".join(nodes[a:b]))
                            ends.append(len(names))
                bound = pa.MapArray.from_arrays(pa.array(ends, pa.int32()), pa.array(names, pa.string()), pa.array(values, pa.string()))
                columns = [pa.array(which, pa.int64()), batch.column(key).take(pa.array(rows, pa.int64())), pa.array(at, pa.int32()), bound]
                yield pa.RecordBatch.from_arrays(columns, names=["pattern", key, "at", "bindings"])

    schema = f"pattern bigint, `{key}` {df.schema[key].dataType.simpleString()}, at int, bindings map<string,string>"
    return df.select(key, term, *[proposed] * bool(proposed)).mapInArrow(confirm, schema)


def hit_rates(found: DataFrame, patterns: int, key: str) -> DataFrame:
    """(key, hit): the share of patterns that a term holds; terms without any are left out."""
    return found.groupBy(key).agg((F.count_distinct("pattern") / F.lit(patterns)).alias("hit"))
