"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Words are runs of non-white characters with A-Z lower-cased; a document's set holds the 64-bit hashes of
its distinct runs of five words (of the whole sequence if it has fewer words). Circulant MinHash (Li and Li,
2021) needs two permutations of the hash range: the first, sigma, breaks structure; the second, pi,
circularly shifted by k, gives coordinate k = min over the set of pi(sigma(x) - k mod 2**64). Both are
bijections of the 64-bit numbers. BANDS bands of ROWS coordinates make a pair at similarity
0.85 share no band with probability 2e-7, at 0.80 with 3e-5. Documents are linked from PERCENT on; op2 has its own
threshold, OP2_PERCENT.

1. Equal sets collapse to the least doc_id among them, before anything else is compared.
2. In each bucket every member is compared with the least member (a star, not all pairs), on the full sets.
3. Components of those links. A bucket of three or more that still spans several components
   is compared further, in blocks of at most BLOCK documents by BLOCK, again on full sets; a block reports a
   spanning forest of its links, never all pairs. Nothing is capped, so no link of a shared bucket is lost.
4. Components of all links; their least doc_id is the document that stays.

Sets are computed from the texts where they are needed and are never all kept.

Defined results: null, empty and wordless texts have an empty set and are linked with nothing; rows
that share a doc_id are one document, linked by any of its texts, and stay or go together; rows with a null doc_id are linked with nothing, have no component and stay;
an empty table gives an empty result; other columns are carried through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semlake.llm.bytewords import ASCII_LOWER, IS_WHITE, mix, slices, word_hashes, words
from semlake.llm.common import broadcast_within, hold_only, map_batches, materialise, remove, scratch, ship, table, unused
from semlake.llm.components import components

WORDS, PERCENT, OP2_PERCENT = 5, 80, 85
ROWS, BANDS = 5, 26
#: Documents, and bytes of their sets, on either side of a block.
BLOCK, BLOCK_BYTES = 512, 4 << 20
#: Shingles by coordinates that are hashed at once.
CELLS = 1 << 17
_U = np.uint64
_SHINGLE, _SIGMA, _PI = _U(0x9E3779B97F4A7C15), _U(0xA0761D6478BD642F), _U(0xE7037ED1A0B428DB)


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for row, end, data, offsets in slices(column):
        data = ASCII_LOWER[data]
        starts, lengths, first = words(data, offsets, IS_WHITE)
        h = word_hashes(data, starts, lengths)
        runs = h.copy()
        full = max(0, len(h) - WORDS + 1)
        for k in range(1, WORDS):
            runs[:full] = mix(runs[:full] * _SHINGLE + h[k : k + full])
        for i in range(end - row):
            a, b = int(first[i]), int(first[i + 1])
            if b - a >= WORDS:
                yield np.unique(runs[a : b - WORDS + 1])
            elif b == a:
                yield np.zeros(0, np.uint64)
            else:
                one = h[a : a + 1].copy()
                for k in range(a + 1, b):
                    one = mix(one * _SHINGLE + h[k : k + 1])
                yield one


def signature(shingles: np.ndarray) -> np.ndarray:
    """ROWS * BANDS coordinates."""
    x = mix(shingles ^ _SIGMA)
    out = np.empty(ROWS * BANDS, np.uint64)
    step = max(1, CELLS // len(x))
    for k in range(0, len(out), step):
        shift = np.arange(k, min(k + step, len(out)), dtype=np.uint64)[:, None]
        y = x - shift  # then pi, in place
        y ^= _PI
        y *= _SHINGLE
        y ^= y >> _U(32)
        y *= _SIGMA
        out[k : k + step] = y.min(1)
    return out


def band_hashes(sig: np.ndarray) -> np.ndarray:
    """One number for each band: its place and its coordinates."""
    rows = sig.reshape(BANDS, ROWS)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        out = mix(out * _SHINGLE + rows[:, k])
    return out.astype(np.int64)


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, nd_n, nd_a, nd_b, nd_bands): size, 128-bit digest and bands of each document's set."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n, a, b, bands = [], [], [], []
        for s in shingle_sets(batch.column("text")):
            n.append(len(s))
            if len(s):
                da, db = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64).tolist()
                a.append(da)
                b.append(db)
                bands.append(band_hashes(signature(s)))
            else:
                a.append(None)
                b.append(None)
                bands.append(None)
        columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "nd_n", "nd_a", "nd_b", "nd_bands"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id bigint, nd_n bigint, nd_a bigint, nd_b bigint, nd_bands array<bigint>", keep=False)


def sets_of(docs: DataFrame, nodes: DataFrame, count: int) -> DataFrame:
    """(node, s): the sets of the documents named in nodes, as bytes."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([s.tobytes() for s in shingle_sets(batch.column("text"))], pa.binary())], names=["node", "s"])

    some = docs.select("doc_id", "text").join(broadcast_within(nodes, count * 16), F.col("doc_id") == F.col("node"))
    return map_batches(some.select("node", "text"), run, "node bigint, s binary", keep=False)


def linked(both: int, a: int, b: int, percent: int) -> bool:
    return 100 * both >= percent * (a + b - both)


def verify(pairs: DataFrame, percent: int) -> DataFrame:
    """The (u, v) of rows (u, v, su, sv) whose sets are similar enough."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ok = []
        for su, sv in zip(batch.column("su"), batch.column("sv"), strict=True):
            x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (su, sv))
            few, many = sorted((len(x), len(y)))
            ok.append(100 * few >= percent * many and linked(few + many - len(np.union1d(x, y)), few, many, percent))
        yield batch.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))

    return map_batches(pairs, run, "u bigint, v bigint", keep=False)


def block_links(nodes: list[np.ndarray], comps: list[np.ndarray], sets: list[list[np.ndarray]], percent: int = PERCENT) -> list[tuple[int, int]]:
    """A spanning forest of the links between the documents of two sides that are in different components.
    One side alone is compared with itself."""
    every = [s for side in sets for s in side]
    shingle, number = np.unique(np.concatenate(every), return_inverse=True)
    size = np.array([len(s) for s in every])
    owner = np.repeat(np.arange(len(every)), size)
    again = np.bincount(number, minlength=len(shingle))[number] > 1  # a shingle of one document joins nothing
    kept, number = np.unique(number[again], return_inverse=True)
    owner = owner[again]
    cut = len(sets[0]) if len(sets) > 1 else 0
    left, right = (range(cut), range(cut, len(every))) if cut else (range(len(every)), range(len(every)))
    both = np.zeros((len(left), len(right)), np.float32)
    width = max(1, (16 << 20) // (4 * len(every)))
    for first in range(0, len(kept), width):  # counts are exact in float32 below 2**24
        part = (number >= first) & (number < first + width)
        held = np.zeros((len(every), min(width, len(kept) - first)), np.float32)
        held[owner[part], number[part] - first] = 1
        both += held[left.start : left.stop] @ held[right.start : right.stop].T
    comp, node = np.concatenate(comps), np.concatenate(nodes)
    a, b = size[left.start : left.stop, None], size[None, right.start : right.stop]
    hit = (100 * both >= percent * (a + b - both)) & (comp[left.start : left.stop, None] != comp[None, right.start : right.stop])
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    out = []
    for i, j in np.argwhere(hit).tolist():
        x, y = find(int(comp[left.start + i])), find(int(comp[right.start + j]))
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((int(node[left.start + i]), int(node[right.start + j])))
    return out


def compare_blocks(rows: DataFrame, percent: int) -> DataFrame:
    """Links of rows (bh, x, y, i, node, c, s), which are brought together by block (bh, x, y): side x meets side y."""

    def meet(members: list[tuple]) -> list[tuple[int, int]]:
        sides = [[m for m in members if m[0] == k] for k in sorted({members[0][4], members[0][5]})]
        if not all(sides):
            return []
        return block_links(*([np.array([m[k] for m in s], np.int64) for s in sides] for k in (1, 2)), [[np.frombuffer(m[3], np.uint64) for m in s] for s in sides], percent)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_only(__name__)
        key, held = None, []
        for batch in batches:
            out = []
            columns = [batch.column(n).to_pylist() for n in ("bh", "i", "node", "c", "s", "x", "y")]
            for bh, *member in zip(*columns, strict=True):
                if (now := (bh, *member[4:])) != key:
                    out += meet(held) if held else []
                    key, held = now, []
                held.append(tuple(member))
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in out], pa.int64()) for k in (0, 1)], names=["u", "v"])
        out = meet(held) if held else []
        yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in out], pa.int64()) for k in (0, 1)], names=["u", "v"])

    ship(rows.sparkSession)
    rows = rows.select("bh", "i", "node", "c", "s", "x", "y").repartition("bh", "x", "y").sortWithinPartitions("bh", "x", "y")
    return rows.mapInArrow(each, "u bigint, v bigint")


def near_links(docs: DataFrame, held: DataFrame, path: str, percent: int) -> DataFrame:
    """(node, component) of the representatives that are linked with another; held: sketches with nd_rep."""
    rows = held.where(F.col("doc_id") == F.col("nd_rep")).select(F.col("nd_rep").alias("node"), F.explode("nd_bands").alias("bh"))
    # A repeated row counts once more here, which only costs work.
    seen = rows.groupBy("bh").agg(F.min("node").alias("hub"), F.max("node").alias("last"), F.count("*").alias("n")).where("hub <> last").drop("last")
    # Written first: where it is small enough the rows stay where they are, else a join of two plain exchanges can be
    # split where a bucket is hot.
    seen = materialise(seen, f"{path}/seen")
    multi = materialise(rows.join(broadcast_within(seen, seen.count() * 32), "bh"), f"{path}/buckets")
    star = materialise(multi.where("node <> hub").select(F.col("node").alias("u"), F.col("hub").alias("v")).distinct(), f"{path}/star")
    nodes = star.select(F.col("u").alias("node")).union(star.select(F.col("v").alias("node"))).distinct()
    sets = materialise(sets_of(docs, nodes, nodes.count()), f"{path}/sets")
    pairs = star.join(sets.select(F.col("node").alias("u"), F.col("s").alias("su")), "u").join(sets.select(F.col("node").alias("v"), F.col("s").alias("sv")), "v")
    links = materialise(verify(pairs.select("u", "v", "su", "sv"), percent), f"{path}/links")
    first = materialise(components(links, f"{path}/first"), f"{path}/first-components")
    # Buckets of three or more that span components: their other pairs, in blocks.
    more = multi.where("n > 2").join(first, "node", "left").select("bh", "node", "n", F.coalesce("component", "node").alias("c"))
    open_ = more.groupBy("bh").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1").select("bh")
    open_ = materialise(open_, f"{path}/open-buckets")
    more = more.join(broadcast_within(open_, open_.count() * 16), "bh", "left_semi").join(sets, "node")
    more = materialise(more, f"{path}/open")
    total = more.groupBy("bh").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(F.length("s")) / BLOCK_BYTES)).cast("int").alias("k"))
    total = materialise(total, f"{path}/blocks")
    more = more.join(broadcast_within(total, total.count() * 24), "bh").withColumn("i", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    more = more.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    more = more.withColumns({"x": F.least("i", "j"), "y": F.greatest("i", "j")})
    extra = materialise(compare_blocks(more, percent), f"{path}/extra")
    if not extra.isEmpty():
        first = materialise(components(links.union(extra), f"{path}/second"), f"{path}/second-components")
    for part in ("seen", "buckets", "star", "sets", "links", "first", "open-buckets", "open", "blocks", "extra", "second"):
        remove(docs.sparkSession, f"{path}/{part}")
    return first


def classes(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, nd_shingles, nd_component) of every row; documents whose Jaccard similarity is percent / 100 or more are linked."""
    path = scratch(docs.sparkSession)
    held = materialise(sketches(docs), f"{path}/sketches")
    least = held.where("nd_a is not null and doc_id is not null").groupBy("nd_a", "nd_b").agg(F.min("doc_id").alias("nd_least"), F.count("*").alias("n"))
    # Only sets of several documents are looked up. Written first: if it is too large to broadcast, the join of two
    # plain exchanges can be split where a set is hot.
    least = materialise(least.where("n > 1").drop("n"), f"{path}/least")
    # Null doc_ids keep a null representative, and so stay out of the buckets.
    rep = F.when(F.col("doc_id").isNotNull(), F.coalesce("nd_least", "doc_id"))
    held = materialise(held.join(broadcast_within(least, least.count() * 48), ["nd_a", "nd_b"], "left").select("doc_id", "nd_n", "nd_bands", rep.alias("nd_rep")), f"{path}/reps")
    for part in ("sketches", "least"):
        remove(docs.sparkSession, f"{path}/{part}")
    found = near_links(docs, held, path, percent)
    out = held.join(broadcast_within(found, found.count() * 32), F.col("nd_rep") == F.col("node"), "left")
    return out.select("doc_id", F.col("nd_n").alias("nd_shingles"), F.coalesce("component", "nd_rep").alias("nd_component"))


def near_dedup(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents without those that are in a class with a lesser doc_id."""
    (name,) = unused(docs, "nd_gone")
    gone = materialise(classes(docs, percent).where("doc_id <> nd_component").select(F.col("doc_id").alias(name)).distinct(), scratch(docs.sparkSession))
    return docs.join(broadcast_within(gone, gone.count() * 16), F.col("doc_id") == F.col(name), "left_anti")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classes(table(spark, sf_dir, "documents").select("doc_id", "text"), OP2_PERCENT)
    kept = F.coalesce(F.col("doc_id") == F.col("nd_component"), F.lit(True))
    return out.select("doc_id", F.col("nd_shingles").alias("n_shingles"), F.col("nd_component").alias("component_id"), kept.alias("kept"))


OP2_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT u, v FROM i JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * i >= 85 * (x.n + y.n - i)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r AS (SELECT doc_id, doc_id AS m FROM d UNION SELECT e.v, r.m FROM r JOIN e ON r.doc_id = e.u)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.m AS component_id, d.doc_id = c.m AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT doc_id, min(m) AS m FROM r GROUP BY doc_id) c ON c.doc_id = d.doc_id
"""
