"""SimHash near-duplicate search with bit-sliced comparison of fingerprints.

Words are runs of non-white characters with A-Z lower-cased; a text's shingles are its runs of four words joined by
single spaces, repeats included (the whole sequence if it has fewer words). Each is hashed by XXH64 (UTF-8, seed 42);
a bit of the 64-bit fingerprint is 1 if more than half of the hashes have it. Texts are linked if their fingerprints
differ in RADIUS bits or fewer.

1. Equal fingerprints collapse to the least doc_id among them.
2. The 64 bits are dealt into RADIUS + m parts; two fingerprints within the radius agree in m parts at least, so for
   each choice of m parts the fingerprints are put into buckets by those bits. m follows from the number of
   fingerprints, so that a bucket of random ones holds about PER_BUCKET at most; every choice is exact.
3. Buckets are sorted runs of one range-partitioned table, so that a hot bucket spreads over tasks. A run is cut into
   chunks of at most CHUNK fingerprints, and each chunk is compared with itself: bit planes lie one after another
   ("vertically"), 64 fingerprints in a word; carry-save adders count the differing bits of 64 pairs at once, eight
   planes at a time, and what has passed the radius in all 64 places is abandoned.
4. Components of those links. Where a bucket has several chunks, its rows are sorted anew by their component, and the
   pairs of chunks are compared, but for those that lie in one component altogether. Nothing is capped.
5. A comparison reports, for the members of a connected group, links to its least member only, never all pairs.

The last step takes time in proportion to the pairs of *unlinked, different* fingerprints of one bucket.

Defined results: null, empty and wordless texts have fingerprint zero and are linked like any other; each row has its
own fingerprint, so rows that share a doc_id may be in several components; rows with a null doc_id have a fingerprint
and the component of what it is linked with (null if nothing has a doc_id), but hand out no doc_id; an empty table gives an empty
result; other columns are carried through by ``with_simhash``, but for one named like the new one, which is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from semlake.llm.bytewords import ASCII_LOWER, IS_WHITE, slices, words
from semlake.llm.common import broadcast_within, hold_only, map_batches, materialise, remove, scratch, ship, table
from semlake.llm.components import components

WORDS, SEED, RADIUS = 4, 42, 4
#: Random fingerprints that a bucket holds at most, and members of a chunk.
PER_BUCKET, CHUNK = 64, 2048
#: (fingerprint, 64 others) that are compared together.
ITEMS = 1 << 13
_U = np.uint64
_ONES, _ZERO = _U(0xFFFFFFFFFFFFFFFF), _U(0)
#: Of each byte, its bits in eight byte-wide counters.
_SPREAD = np.array([sum((b >> i & 1) << 8 * i for i in range(8)) for b in range(256)], np.uint64)


def bit_sums(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(rows, 64): how many of the hashes first[i]..first[i + 1] have each bit. Byte-wide counters take 255 hashes at most."""
    n = np.diff(first)
    out = np.zeros((len(n), 64), np.int64)
    pieces = -(-n // 255)
    owner = np.repeat(np.arange(len(n)), pieces)
    if len(owner):
        at = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        sums = np.add.reduceat(_SPREAD[h.view(np.uint8).reshape(-1, 8)], first[owner] + 255 * at, axis=0)
        some = np.flatnonzero(n)
        out[some] = np.add.reduceat(sums.view(np.uint8).reshape(-1, 64), np.searchsorted(owner, some), axis=0, dtype=np.int64)
    return out


def fingerprints(column: pa.Array) -> np.ndarray:
    """The fingerprint of each text."""
    out = np.zeros(len(column), np.uint64)
    for row, end, data, offsets in slices(column):
        data = ASCII_LOWER[data]
        starts, lengths, first = words(data, offsets, IS_WHITE)
        if not len(starts):
            continue
        # The words of each text, with one space between them.
        many = np.diff(first)
        inner = np.ones(len(starts), bool)
        inner[first[1:][many > 0] - 1] = False
        keep, gaps = ~IS_WHITE[data], (starts + lengths)[inner]
        keep[gaps], data[gaps] = True, 32
        place = np.cumsum(keep)
        joined, begins, ends = data[keep].tobytes(), place[starts] - 1, place[starts + lengths - 1]
        shingles = np.where(many >= WORDS, many - WORDS + 1, np.minimum(many, 1))
        before = np.cumsum(shingles) - shingles
        head = np.repeat(first[:-1] - before, shingles) + np.arange(int(shingles.sum()))
        cuts = zip(begins[head].tolist(), ends[head + np.repeat(np.minimum(many, WORDS) - 1, shingles)].tolist(), strict=True)
        h = np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in cuts), np.uint64, len(head))
        over = 2 * bit_sums(h, np.append(before, len(h))) > shingles[:, None]
        out[row:end] = np.packbits(over, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def with_simhash(docs: DataFrame, name: str = "sh") -> DataFrame:
    """The documents with their fingerprints, as signed 64-bit numbers, in a column ``name``."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fingerprints(batch.column("text")).view(np.int64))], names=[*batch.schema.names, name])

    return map_batches(docs, run, f"{name} bigint")


def planes(fp: np.ndarray) -> np.ndarray:
    """(64, words): the bit planes of fingerprints, 64 of them in a word."""
    full = np.zeros(-(-len(fp) // 64) * 64, np.uint64)
    full[: len(fp)] = fp
    bits = np.unpackbits(full.view(np.uint8).reshape(-1, 64, 8), axis=2, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.transpose(2, 0, 1)), axis=2, bitorder="little").view(np.uint64)[:, :, 0]


def _add(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Carry-save addition in each bit: sum and carry."""
    half = a ^ b
    return half ^ c, (a & b) | (half & c)


def _beyond(c2: np.ndarray, c1: np.ndarray, c0: np.ndarray, radius: int) -> np.ndarray:
    """Where the number with these bits is over the radius (at most 7)."""
    over, same = np.zeros_like(c0), np.full_like(c0, _ONES)
    for k, c in ((2, c2), (1, c1), (0, c0)):
        if radius >> k & 1:
            same = same & c
        else:
            over, same = over | (same & c), same & ~c
    return over


def close(q: np.ndarray, of: np.ndarray, word: np.ndarray, wanted: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each item the places of planes ``of[:, word]`` within the radius of q, among the wanted ones. Items are
    abandoned when all their 64 places have passed the radius."""
    out, item = np.zeros(len(q), np.uint64), np.arange(len(q))
    over = ~wanted
    c0, c1, c2 = (np.zeros(len(q), np.uint64) for _ in range(3))
    for g in range(0, 64, 8):
        bits = (q >> np.arange(g, g + 8, dtype=np.uint64)[:, None]) & _U(1)
        x = of[g : g + 8, word] ^ (_ZERO - bits)
        s, a = _add(c0, x[0], x[1])
        s, b = _add(s, x[2], x[3])
        c1, e = _add(c1, a, b)
        s, a = _add(s, x[4], x[5])
        c0, b = _add(s, x[6], x[7])
        c1, f = _add(c1, a, b)
        c2, eight = _add(c2, e, f)
        over = over | eight
        gone = over | _beyond(c2, c1, c0, radius)
        on = np.flatnonzero(gone != _ONES)
        if g == 56:
            out[item[on]] = ~gone[on]
        elif len(on) < 0.8 * len(item):
            item, q, word, over, c0, c1, c2 = (z[on] for z in (item, q, word, over, c0, c1, c2))
    return out


def join_up(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Labels (each that of the least member known) after linking u with v."""
    while True:
        a, b = label[u], label[v]
        apart = a != b
        if not apart.any():
            return label
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(label, up := label[label]):
            label = up


def group(first: np.ndarray, last: np.ndarray, at: np.ndarray, fp: np.ndarray, comp: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links between components: fingerprint at[i] is compared with those from first[i] up to last[i]. Each component
    that meets another is linked with the least (in order) that it is connected with."""
    _, lead, back = np.unique(comp, return_index=True, return_inverse=True)
    own = lead[back]
    label, of = own.copy(), planes(fp)
    some = last > first
    first, last, at = first[some], last[some], at[some]
    n = (last - 1) // 64 - first // 64 + 1
    ends = np.cumsum(n)
    for begin in range(0, int(ends[-1]) if len(n) else 0, ITEMS):
        i = np.arange(begin, min(begin + ITEMS, int(ends[-1])))
        r = np.searchsorted(ends, i, "right")
        word = first[r] // 64 + i - (ends[r] - n[r])
        low = np.maximum(first[r] - 64 * word, 0).astype(np.uint64)
        high = np.minimum(last[r] - 64 * word, 64).astype(np.uint64)
        hit = close(fp[at[r]], of, word, (_ONES << low) & (_ONES >> (_U(64) - high)), radius)
        some = np.flatnonzero(hit)
        which, lane = np.nonzero(np.unpackbits(hit[some].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        label = join_up(label, at[r[some[which]]], 64 * word[some[which]] + lane)
    moved = np.flatnonzero((own == np.arange(len(own))) & (label != own))
    return comp[moved], comp[label[moved]]


def parts_for(count: int, radius: int = RADIUS) -> tuple[int, list[int]]:
    """(m, a mask for each choice of m of radius + m parts) for so many fingerprints."""
    for m in range(1, 5):
        cuts = [64 * i // (radius + m) for i in range(radius + m + 1)]
        part = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]
        masks = [sum(c) for c in combinations(part, m)]
        if count <= PER_BUCKET << min(x.bit_count() for x in masks):
            break
    return m, [x - (1 << 64) if x >> 63 else x for x in masks]


def _runs(rows: DataFrame, schema: str, use) -> DataFrame:
    """Rows (t, k, c, fp) sorted over all partitions and cut into chunks: use(t, k, c, fp, start of each bucket) for many
    whole chunks at a time, then use.ends(..). A chunk lies in one bucket and one partition."""
    spark = rows.sparkSession
    ship(spark)
    names, owner, make = ("t", "k", "c", "fp"), __name__, use
    rows = rows.select(*names).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *names).sortWithinPartitions(*names)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_only(owner)
        run, held, size = make(), [], 0
        for batch in batches:
            held.append([batch.column(c).to_numpy() for c in names])
            size += batch.num_rows
            if size >= 16 * CHUNK:
                whole = [np.concatenate(x) for x in zip(*held, strict=True)]
                new = np.flatnonzero((whole[0][1:] != whole[0][:-1]) | (whole[1][1:] != whole[1][:-1])) + 1
                last = int(new[-1]) if len(new) else 0
                cut = last + (size - last - 1) // CHUNK * CHUNK  # of the last bucket, whole chunks only
                yield from run([x[:cut] for x in whole])
                held, size = [[x[cut:] for x in whole]], size - cut
        if size:
            yield from run([np.concatenate(x) for x in zip(*held, strict=True)])
        yield from run(None)

    return rows.mapInArrow(each, schema)


def _chunks(t: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Where chunks begin, and the end."""
    new = np.concatenate([[0], np.flatnonzero((t[1:] != t[:-1]) | (k[1:] != k[:-1])) + 1, [len(t)]])
    if np.diff(new).max(initial=0) <= CHUNK:
        return new
    return np.concatenate([*(np.arange(a, b, CHUNK) for a, b in zip(new[:-1], new[1:], strict=True)), [len(t)]])


def first_links(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v) of the links within chunks, and (t, k, chunks) of the buckets that may have several."""

    def make():
        seen: list[tuple[int, int, int, bool]] = []  # buckets so far that are kept; the last may go on

        def run(whole):
            if whole is None:
                out = [b[:3] for i, b in enumerate(seen) if b[2] > 1 or i in (0, len(seen) - 1)]
                cols = [pa.array([b[i] for b in out], kind) for i, kind in enumerate((pa.int32(), pa.int64(), pa.int64()))]
                none = pa.nulls(len(out), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, *cols], names=["u", "v", "t", "k", "chunks"])
                return
            t, k, c, fp = whole
            cuts = _chunks(t, k)
            last = np.repeat(cuts[1:], np.diff(cuts))
            at = np.arange(len(t))
            u, v = group(at + 1, last, at, fp.view(np.uint64), c, radius)
            nothing = pa.nulls(len(u), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), nothing.cast(pa.int32()), nothing, nothing], names=["u", "v", "t", "k", "chunks"])
            for a, b in zip(t[cuts[:-1]].tolist(), k[cuts[:-1]].tolist(), strict=True):
                if seen and seen[-1][:2] == (a, b):
                    seen[-1] = (a, b, seen[-1][2] + 1)
                else:
                    if len(seen) > 1 and seen[-1][2] == 1:
                        seen.pop()
                    seen.append((a, b, 1))

        return run

    return _runs(rows, "u bigint, v bigint, t int, k bigint, chunks bigint", make)


def _packed(rows: DataFrame) -> DataFrame:
    """A row for each chunk, its numbers as bytes."""

    def make():
        import uuid

        def run(whole):
            if whole is not None:
                t, k, c, fp = whole
                cuts = _chunks(t, k)
                sides = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
                at = cuts[:-1]
                columns = [
                    pa.array([uuid.uuid4().hex for _ in sides]), pa.array(t[at]), pa.array(k[at]), pa.array(c[at]), pa.array(c[cuts[1:] - 1]),
                    pa.array([c[a:b].tobytes() for a, b in sides], pa.binary()), pa.array([fp[a:b].tobytes() for a, b in sides], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "t", "k", "c0", "c1", "cs", "fps"])

        return run

    return _runs(rows, "id string, t int, k bigint, c0 bigint, c1 bigint, cs binary, fps binary", make)


def pair_links(pairs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links between two chunks (or within one) of components: rows (same, cs, fps, cs2, fps2)."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        us, vs = [], []
        for same, *parts in zip(batch.column("same").to_pylist(), *(batch.column(c) for c in ("cs", "fps", "cs2", "fps2")), strict=True):
            c, fp, c2, fp2 = (np.frombuffer(x.as_buffer(), np.int64) for x in parts)
            n, at = len(c), np.arange(len(c))
            if same:
                u, v = group(at + 1, np.full(n, n), at, fp.view(np.uint64), c, radius)
            else:
                u, v = group(np.full(n, n), np.full(n, n + len(c2)), at, np.concatenate([fp, fp2]).view(np.uint64), np.concatenate([c, c2]), radius)
            us.append(u)
            vs.append(v)
        empty = [np.zeros(0, np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us or empty)), pa.array(np.concatenate(vs or empty))], names=["u", "v"])

    return map_batches(pairs.select("same", "cs", "fps", "cs2", "fps2"), run, "u bigint, v bigint", keep=False)


def fingerprint_components(prints: DataFrame, path: str, radius: int = RADIUS) -> DataFrame:
    """(node, component) of the distinct fingerprints (column fp) that are linked with another one; the component is a fingerprint."""
    spark = prints.sparkSession
    _, masks = parts_for(prints.count(), radius)
    keys = F.explode(F.array(*(F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("k")) for i, m in enumerate(masks))))
    rows = prints.select("fp", keys.alias("b")).select("b.t", "b.k", F.col("fp").alias("c"), "fp")
    got = materialise(first_links(rows, radius), f"{path}/first")
    links = got.where("u is not null").select("u", "v")
    found = materialise(components(links, f"{path}/first-rounds"), f"{path}/first-components")
    many = got.where("u is null").groupBy("t", "k").agg(F.sum("chunks").alias("n")).where("n > 1").select("t", "k")
    many = materialise(many, f"{path}/many")
    if not many.isEmpty():
        wide = rows.drop("c").join(broadcast_within(many, many.count() * 16), ["t", "k"], "left_semi")
        wide = wide.join(found, F.col("fp") == F.col("node"), "left").select("t", "k", F.coalesce("component", "fp").alias("c"), "fp")
        packed = materialise(_packed(wide), f"{path}/packed")
        a = packed.select("t", "k", "id", "c0", "c1")
        b = packed.select("t", "k", F.col("id").alias("id2"), F.col("c0").alias("d0"), F.col("c1").alias("d1"))
        pairs = a.join(b, ["t", "k"]).where("id <= id2 and not (c0 = c1 and d0 = d1 and c0 = d0)").select("id", "id2")
        pairs = materialise(pairs, f"{path}/pairs")
        full = pairs.join(packed.select("id", "cs", "fps"), "id").join(packed.select(F.col("id").alias("id2"), F.col("cs").alias("cs2"), F.col("fps").alias("fps2")), "id2")
        more = materialise(pair_links(full.withColumn("same", F.expr("id = id2")).repartition("id", "id2"), radius), f"{path}/second")
        if not more.isEmpty():
            found = materialise(components(links.union(more), f"{path}/second-rounds"), f"{path}/second-components")
    for part in ("first", "first-rounds", "many", "packed", "pairs", "second", "second-rounds"):
        remove(spark, f"{path}/{part}")
    return found


def classes(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, sh_print, sh_component) of every row; the fingerprint as a signed number, the component as its least doc_id."""
    spark = docs.sparkSession
    path = scratch(spark)
    held = materialise(with_simhash(docs.select("doc_id", "text"), "fp").select("doc_id", "fp"), f"{path}/prints")
    reps = materialise(held.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), f"{path}/reps")
    found = fingerprint_components(reps.select("fp"), path, radius)
    least = found.join(reps, F.col("node") == F.col("fp")).groupBy("component").agg(F.min("rep").alias("least"))
    ours = reps.join(found.join(least, "component"), F.col("fp") == F.col("node"), "left")
    # Only fingerprints of several rows, or that are linked, are looked up.
    look = ours.where("n > 1 or node is not null").select(F.col("fp").alias("sh_fp"), F.when(F.col("node").isNull(), F.col("rep")).otherwise(F.col("least")).alias("least"))
    look = materialise(look, f"{path}/lookup")
    out = held.join(broadcast_within(look, look.count() * 24), F.col("fp") == F.col("sh_fp"), "left")
    for part in ("reps", "first-components", "second-components"):
        remove(spark, f"{path}/{part}")
    return out.select("doc_id", F.col("fp").alias("sh_print"), F.coalesce("least", "doc_id").alias("sh_component"))


def hex16(c: Column) -> Column:
    """A signed 64-bit number as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(c), 16, "0"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", hex16(F.col("sh_print")).alias("fingerprint"), F.col("sh_component").alias("component_id"))
