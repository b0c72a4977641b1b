"""Token-ID output: concatenated ids with Elias-Fano coded document boundaries.

A shard is one byte string::

    magic "SLTK", version, id width (2 or 4), counts   fixed header, little-endian
    ids                                                n_ids unsigned integers
    boundaries                                         Elias-Fano list of n_docs + 1 offsets
    document ids                                       Elias-Fano list of doc_id - least doc_id

An Elias-Fano list of n values up to u keeps the low floor(log2(u / n)) bits of each value
packed, and the rest as a unary bit string of n ones; ``select`` finds the i-th one from
samples of every 256th one, so an offset costs about 2 + log2(u / n) bits and no table of 64-bit
offsets is kept. Documents are dealt into ascending ranges of doc_id; a range is cut into shards
of at most SHARD_IDS ids (or one document). Each shard is a row of a Parquet folder
written by Spark, so the commit protocol of the store holds; ``export`` writes them as plain files.

Defined results: null text is empty and has the end id alone; null doc_ids come first;
repeated doc_ids are ordered by text (null text first) and keep their order of writing; empty
tables give an empty folder and result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import accumulate, chain, pairwise, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semlake.llm.common import WordIds, cached, hold_only, map_batches, ragged, row_slices, scratch, ship, table

END_ID, SHARD_IDS, SAMPLE = 2, 1 << 19, 256
#: Distinct chunks of text without white space that a task remembers before it starts afresh.
MEMORY = 800_000
#: Bytes of text whose chunks are looked up together.
STEP_BYTES = 1 << 20
MAGIC = b"SLTK"
HEADER = np.dtype([("magic", "S4"), ("version", "<u2"), ("width", "<u2"), ("docs", "<u8"), ("nulls", "<u8"), ("ids", "<u8"), ("least", "<i8"), ("bounds", "<u8")])


class EliasFano:
    """A list of non-decreasing integers in n * (2 + log2(u / n)) bits, and 32 bits for each 256 values."""

    HEAD = np.dtype([("n", "<u8"), ("u", "<u8"), ("low", "<u1")])

    def __init__(self, n: int, u: int, low: int, lows: np.ndarray, highs: np.ndarray, samples: np.ndarray):
        self.n, self.u, self.low, self.lows, self.highs, self.samples = n, u, low, lows, highs, samples

    @classmethod
    def of(cls, values) -> EliasFano:
        v = np.asarray(values, dtype=np.uint64)
        n, u = len(v), int(v[-1]) if len(v) else 0
        low = max(0, (u // n).bit_length() - 1) if n else 0
        lows = ((v[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).reshape(-1)
        ones = (v >> np.uint64(low)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        bits[ones] = 1
        return cls(n, u, low, np.packbits(lows, bitorder="little"), np.packbits(bits, bitorder="little"), ones[::SAMPLE].astype("<u4"))

    def to_bytes(self) -> bytes:
        return np.array([(self.n, self.u, self.low)], self.HEAD).tobytes() + self.lows.tobytes() + self.highs.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> tuple[EliasFano, int]:
        """The list at the start of raw, and its length in bytes."""
        n, u, low = (int(x) for x in np.frombuffer(raw, cls.HEAD, 1)[0])
        a = cls.HEAD.itemsize
        b = a + (n * low + 7) // 8
        c = b + (((u >> low) + n + 7) // 8 if n else 0)
        d = c + 4 * -(-n // SAMPLE)
        return cls(n, u, low, np.frombuffer(raw[a:b], np.uint8), np.frombuffer(raw[b:c], np.uint8), np.frombuffer(raw[c:d], "<u4")), d

    def _lows(self, first: int, last: int) -> np.ndarray:
        if not self.low:
            return np.zeros(last - first, np.uint64)
        at, end = first * self.low, last * self.low
        bits = np.unpackbits(self.lows[at // 8 : -(-end // 8)], bitorder="little")[at % 8 : at % 8 + end - at]
        return (bits.reshape(-1, self.low).astype(np.uint64) << np.arange(self.low, dtype=np.uint64)).sum(1, dtype=np.uint64)

    def select(self, i: int) -> int:
        """The i-th value: from the nearest sampled one, count ones in the bytes that follow."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(self.samples[i // SAMPLE])
        left, byte = i % SAMPLE, at // 8
        rest = self.highs[byte] >> (at % 8) << (at % 8)
        while left >= (ones := int(rest).bit_count()):
            left -= ones
            byte += 1
            rest = self.highs[byte]
        rest = int(rest)
        for _ in range(left):  # drop the ones before it
            rest &= rest - 1
        one = byte * 8 + (rest & -rest).bit_length() - 1
        return (one - i) << self.low | self._low(i)

    def _low(self, i: int) -> int:
        """The low bits of the i-th value, from the bytes that hold them."""
        at = i * self.low
        held = int.from_bytes(self.lows[at // 8 : (at + self.low + 7) // 8].tobytes(), "little")
        return held >> at % 8 & (1 << self.low) - 1

    def values(self) -> np.ndarray:
        """All values, by one select over the whole bit string."""
        if not self.n:
            return np.zeros(0, np.uint64)
        ones = np.flatnonzero(np.unpackbits(self.highs, bitorder="little"))[: self.n]
        return ((ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low)) | self._lows(0, self.n)


def pack(doc_ids: list[int | None], ids: list[bytes], width: int) -> bytes:
    """A shard of documents in ascending doc_id order, nulls first; ids as little-endian bytes."""
    known = [x for x in doc_ids if x is not None]
    least = known[0] if known else 0
    n_ids = sum(map(len, ids)) // width
    bounds = EliasFano.of(list(accumulate((len(x) // width for x in ids), initial=0))).to_bytes()
    head = np.array([(MAGIC, 1, width, len(ids), len(ids) - len(known), n_ids, least, len(bounds))], HEADER)
    return b"".join([head.tobytes(), *ids, bounds, EliasFano.of([x - least for x in known]).to_bytes()])


class Shard:
    """Reader of one shard; doc(i) needs no pass over the others."""

    def __init__(self, raw: bytes):
        self.head = h = np.frombuffer(raw, HEADER, 1)[0]
        if h["magic"] != MAGIC or h["version"] != 1:
            raise ValueError("not a token-id shard")
        at, self.n = HEADER.itemsize, int(h["docs"])
        end = at + int(h["ids"]) * int(h["width"])
        self.ids = np.frombuffer(raw, f"<u{h['width']}", int(h["ids"]), at)
        self.bounds, used = EliasFano.from_bytes(raw[end:])
        self.docs, _ = EliasFano.from_bytes(raw[end + used :])

    def doc(self, i: int) -> np.ndarray:
        return self.ids[self.bounds.select(i) : self.bounds.select(i + 1)]

    def doc_ids(self) -> list[int | None]:
        return [None] * int(self.head["nulls"]) + [int(x) + int(self.head["least"]) for x in self.docs.values()]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Letters whose composed form and one lower case are themselves or each other: ASCII, and Latin below U+0130.
LETTERS = "A-Za-zÀ-ÖØ-öø-į"


class ChunkEncoder:
    """The library's ids, chunk by chunk between white space; each distinct chunk is encoded once.

    Sound for a tokenizer that composes characters, turns white space into gaps, lower-cases, cuts words out with a pattern and merges
    bytes inside each word: this is checked on loading. Chunks of plain characters (visible ASCII, LETTERS) are lower-cased, those
    not met before are cut here by the tokenizer's own pattern, and the library's model merges each new word. Other chunks go through the
    whole tokenizer."""

    def __init__(self, path: str, memory: int = MEMORY):
        import json

        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        spec = json.load(open(path))
        added = [t["content"] for t in spec["added_tokens"]]
        if any(t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]) or any(map(str.isspace, "".join(added))):
            raise ValueError("added tokens that reach into white space need whole texts")
        normal, cut = (spec[k] or {} for k in ("normalizer", "pre_tokenizer"))
        steps, cuts = normal.get("normalizers", []), cut.get("pretokenizers", [])
        if [x["type"] for x in steps] != ["NFC", "Replace", "Lowercase"] or steps[1]["pattern"] != {"Regex": "\\s+"}:
            raise ValueError("this tokenizer's normaliser is not known to keep chunks apart")
        if [x["type"] for x in cuts] != ["Split", "ByteLevel"] or not cuts[0]["invert"] or cuts[0]["behavior"] != "Removed" or cuts[1]["use_regex"] or cuts[1]["add_prefix_space"]:
            raise ValueError("white space is not dropped by this tokenizer")
        pattern = cuts[0]["pattern"]["Regex"].replace(r"\p{L}", LETTERS).replace(r"\p{N}", "0-9")
        if "\\p" in pattern:
            raise ValueError("the tokenizer's pattern has classes that are not known here")
        self.words = re.compile(pattern + "|\n").findall
        self.plain = re.compile(f"[ \\n\\t!-~{LETTERS}]*").fullmatch
        self.mapped = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.model = Tokenizer.from_file(path)
        self.merge = self.model.model.tokenize
        self.added = re.compile("|".join(map(re.escape, added))).search
        self.border, self.border_id = added[0], self.model.token_to_id(added[0])
        self.width = 2 if max(self.model.get_vocab_size(), END_ID + 1) <= 1 << 16 else 4
        self.table = WordIds(self._make, memory, END_ID)

    def _whole(self, chunks: list[str]) -> list[list[int]]:
        """Ids of chunks by the whole tokenizer: an added token, cut out by it first, stands between them."""
        if any(self.border in c for c in chunks):
            return [self.model.encode(c, add_special_tokens=False).ids for c in chunks]
        ids = np.array(self.model.encode(self.border.join(["", *chunks]), add_special_tokens=False).ids)
        return [x[1:].tolist() for x in np.split(ids, np.flatnonzero(ids == self.border_id))[1:]]

    def _make(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of what _keys gives, and the number of each."""
        rest = [i for i, c in enumerate(chunks) if c[:1] == " "]
        if rest:
            whole = [x for at in range(0, len(rest), 2000) for x in self._whole([chunks[i][1:] for i in rest[at : at + 2000]])]
            chunks = ["" if c[:1] == " " else c for c in chunks]
        # The words of all chunks in one pass, a line feed between the chunks.
        words = self.words("\n".join(chunks))
        number = dict.fromkeys(words)
        number.update(zip(number, range(len(number)), strict=True))
        table, merge, mapped = self.table, self.merge, self.mapped
        known = np.fromiter(map(table.number.get, number, repeat(-1)), np.int64, len(number))  # words that were chunks before
        new = [w for w, k in zip(number, known.tolist(), strict=True) if k < 0 and w != "\n"]
        merged = [[t.id for t in merge(w if w.isascii() else mapped(w)[0][0])] for w in new]
        size = np.zeros(len(number), np.int64)
        fresh = [number[w] for w in new]
        size[fresh] = np.fromiter(map(len, merged), np.int64, len(merged))
        start = table.used + np.cumsum(size) - size
        held = known >= 0
        start[held], size[held] = table.start[known[held]], table.size[known[held]]
        all_ids = np.concatenate([table.ids[: table.used], np.fromiter(chain.from_iterable(merged), np.int32, sum(map(len, merged)))])
        place = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        ids = all_ids[ragged(start[place], size[place])]
        chunk = np.cumsum(place == number["\n"]) if "\n" in number else np.zeros(len(place), np.int64)
        sizes = np.bincount(chunk, weights=size[place], minlength=len(chunks)).astype(np.int64)
        if rest:
            bounds = np.cumsum(sizes)[rest]
            ids = np.insert(ids, np.repeat(bounds, list(map(len, whole))), list(chain.from_iterable(whole)))
            sizes[rest] = list(map(len, whole))
        return ids, sizes

    def _keys(self, text: str) -> list[str]:
        """The chunks of a text, lower-cased; one that is not plain stands as it is, marked by a space before it."""
        if self.plain(text) and not self.added(text):
            return text.lower().split()
        # Only these three separate: what else counts as white space differs between libraries. An empty chunk has no ids.
        chunks = text.replace("\n", " ").replace("\t", " ").split(" ")
        return [c.lower() if self.plain(c) and not self.added(c) else " " + c for c in chunks]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text and the end id, as little-endian bytes."""
        ids, bounds = self.table.look_up([[*self._keys(t), None] for t in texts])
        raw = ids.astype(f"<u{self.width}").tobytes()
        return [raw[a * self.width : b * self.width] for a, b in pairwise(bounds.tolist())]


def write_shards(docs: DataFrame, path: str, tokenizer: str | None = None) -> DataFrame:
    """Encode and write (part, before, n_ids, n_docs, shard); before: ids of the part's earlier shards."""
    tokenizer = tokenizer or default_tokenizer()
    spark = docs.sparkSession
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select("doc_id", "text").repartitionByRange(spread, F.col("doc_id").asc_nulls_first())
    docs = docs.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    fields = ["part", "before", "n_ids", "n_docs", "shard"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_only(__name__)
        coder, number = cached(ChunkEncoder, tokenizer), TaskContext.get().partitionId()
        before, held, keys, ids = 0, 0, [], []

        def flush() -> pa.RecordBatch:
            row = [[number], [before], [held], [len(ids)], [pack(keys, ids, coder.width)]]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=fields)

        for batch in batches:
            for at, size in row_slices(batch.column("text"), STEP_BYTES):
                part = batch.slice(at, size)
                for key, raw in zip(part.column("doc_id").to_pylist(), coder.encode([t or "" for t in part.column("text").to_pylist()]), strict=True):
                    n = len(raw) // coder.width
                    if ids and held + n > SHARD_IDS:
                        yield flush()
                        before, held, keys, ids = before + held, 0, [], []
                    keys.append(key)
                    ids.append(raw)
                    held += n
        if ids:
            yield flush()

    ship(spark)
    schema = "part int, before bigint, n_ids bigint, n_docs bigint, shard binary"
    docs.mapInArrow(each, schema).write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def read_shards(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the shards; totals of the parts, one number
    each, go over the driver."""
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    base = list(zip([r[0] for r in totals], accumulate((r[1] for r in totals), initial=0), strict=False))
    parts = shards.sparkSession.createDataFrame(base, "part int, base bigint")
    rows = shards.join(F.broadcast(parts), "part").select((F.col("base") + F.col("before")).alias("at"), "shard")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at, raw in zip(batch.column("at"), batch.column("shard"), strict=True):
            shard = Shard(raw.as_py())
            keys, base, end = shard.doc_ids(), at.as_py(), 0
            start, size, crc = [], [], []
            for i in range(shard.n):  # offsets come one by one from the bit string
                begin, end = end, shard.bounds.select(i + 1)
                start.append(base + begin)
                size.append(end - begin)
                crc.append(zlib.crc32(shard.ids[begin:end].astype("<u4").tobytes()))
            columns = [pa.array(x, pa.int64()) for x in (keys, start, size, crc)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return map_batches(rows, run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint", keep=False)


def export(shards: DataFrame, uri: str) -> DataFrame:
    """Write each shard as a file <part>-<first id>.sltk below uri, a folder of any store that
    Arrow's file systems open on the executors; returns the names and sizes. A rerun task writes the same files."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(uri)
        store.create_dir(root, recursive=True)
        names, sizes = [], []
        for row in batch.to_pylist():
            names.append(f"{row['part']:06d}-{row['before']:012d}.sltk")
            sizes.append(len(row["shard"]))
            with store.open_output_stream(f"{root}/{names[-1]}") as out:
                out.write(row["shard"])
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(sizes, pa.int64())], names=["name", "bytes"])

    return map_batches(shards, run, "name string, bytes bigint", keep=False)


def op3_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_shards(write_shards(table(spark, sf_dir, "documents"), f"{scratch(spark)}/ids"))
