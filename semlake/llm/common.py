"""What the operators share: the scratch folder, text primitives and size-checked broadcasts."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from itertools import chain, repeat
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Broadcast only tables whose measured size is at most this many bytes.
BROADCAST_BYTES = 32 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Space and the control characters 0x09-0x0D.
WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
WHITE_CLASS = "[\\x20\\x09-\\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder name below spark.checkpoint.dir, which all executors share.

    Only where that setting is missing (local tests) is a temporary folder set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = held.get() if held.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        base = tempfile.mkdtemp(prefix="semlake-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/semlake-{uuid.uuid4().hex}"


def materialise(df: DataFrame, path: str) -> DataFrame:
    """Write a table into the shared folder and read it back: lineage ends there, and a lost
    executor costs a task, not the whole history."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder through Hadoop's file systems."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def broadcast_within(df: DataFrame, n_bytes: int, most: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only when the measured size is within the bound; else Spark shuffles."""
    return F.broadcast(df) if n_bytes <= most else df


def others(df: DataFrame, names: list[str]) -> list[Column]:
    """The columns of df that are not named so (Spark's names know no case)."""
    taken = {n.lower() for n in names}
    return [df[f"`{c}`"] for c in df.columns if c.lower() not in taken]


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores after it as df's columns leave it free."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII text takes the byte-wise path of ``lower``."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def white_words(c: Column) -> Column:
    """Words between white space, A-Z lower-cased; null text has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(c, F.lit(""))), WHITE_CLASS + "+"), "")


def digest128(c: Column) -> Column:
    """128 bits of a text as two longs with different seeds, for use as a join key."""
    return F.struct(F.xxhash64(c).alias("a"), F.xxhash64(F.lit(0x5EED), c).alias("b"))


def sha256_hex(c: Column) -> Column:
    return F.sha2(F.encode(c, "UTF-8"), 256)


class Memory(dict):
    """A bounded table of values that are made when they are first asked for. Half of the bound is
    filled, then put aside as the older half, from which entries in use come back."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.older = make, most // 2, {}

    def __missing__(self, key):
        if (value := self.older.get(key)) is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start, start + 1 .. of each stretch, one stretch after another."""
    ends = np.cumsum(size)
    return np.repeat(start - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)


class WordIds:
    """The ids of words, made for many new words in one call and kept until there would be more than ``most``; then
    the table starts afresh. make(words) gives all their ids in one array and the number of each. The word None has the end id."""

    def __init__(self, make: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int, end: int):
        self.make, self.most, self.end = make, most, end
        self.clear()

    def clear(self) -> None:
        self.number: dict[str | None, int] = {None: 0}
        self.used, self.ids, self.start, self.size = 1, np.array([self.end], np.int32), np.zeros(1, np.int64), np.ones(1, np.int64)

    def learn(self, words: list[str]) -> None:
        n = len(self.number)
        ids, size = self.make(words)
        self.number.update(zip(words, range(n, n + len(words)), strict=True))
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(self.used + len(ids), np.int32)])
        if n + len(words) > len(self.size):
            more = np.zeros(n + len(words), np.int64)
            self.start, self.size = np.concatenate([self.start, more]), np.concatenate([self.size, more])
        self.ids[self.used : self.used + len(ids)] = ids
        self.size[n : n + len(words)] = size
        self.start[n : n + len(words)] = self.used + np.cumsum(size) - size
        self.used += len(ids)

    def look_up(self, texts: list[list[str | None]]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each begins (and the end)."""
        words = list(chain.from_iterable(texts))
        found = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(found < 0).tolist()
        if missing:
            new = dict.fromkeys(map(words.__getitem__, missing))
            if len(self.number) + len(new) > self.most:
                self.clear()
                missing, new = range(len(words)), dict.fromkeys(words)
                new.pop(None, None)
            self.learn(list(new))
            found[missing] = np.fromiter(map(self.number.__getitem__, map(words.__getitem__, missing)), np.int64, len(missing))
        size = self.size[found]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[ragged(self.start[found], size)]
        bounds = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        return ids, np.concatenate([[0], np.append(ends, total)[bounds - 1]]) if len(bounds) else np.zeros(1, np.int64)


class IntTable:
    """A fixed table from integers to integers, looked up for whole arrays: open addressing, key and value in one place. Keys outside
    0..2**43 - 1 or values outside 0..2**20 - 1 don't fit there; such tables are two sorted arrays and a binary search."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, missing: int):
        self.missing = missing
        self.sorted = bool(len(keys)) and not (keys.min() >= 0 and keys.max() < 1 << 43 and values.min() >= 0 and values.max() < 1 << 20)
        if self.sorted:
            self.keys, first = np.unique(keys, return_index=True)
            self.values = values[first]
            return
        bits = max(4, (3 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.place = np.full(1 << bits, -1, np.int64)
        slot = self._slot(keys)
        while len(keys):
            free = self.place[slot] < 0
            self.place[slot[free]] = (keys << 20 | values)[free]  # of several keys one is kept
            left = self.place[slot] >> 20 != keys
            keys, values, slot = keys[left], values[left], (slot[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        x = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x >>= self.shift
        return x.view(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        if self.sorted:
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            return np.where(self.keys[at] == keys, self.values[at], self.missing)
        slot = self._slot(keys)
        held = self.place[slot]
        out = np.where(held < 0, self.missing, held & 0xFFFFF)
        other = np.flatnonzero((held >> 20 != keys) & (held >= 0))
        slot, keys = slot[other], keys[other]
        while len(other):
            slot = (slot + 1) & self.mask
            held = self.place[slot]
            out[other] = np.where(held < 0, self.missing, held & 0xFFFFF)
            on = (held >> 20 != keys) & (held >= 0)
            other, slot, keys = other[on], slot[on], keys[on]
        return out


_HELD: dict = {}
_OWNER = ""


def hold_only(owner: str) -> None:
    """What another operator's tasks have left in this Python worker goes: workers outlive stages."""
    global _OWNER
    if owner == _OWNER:
        return
    gc.set_threshold(200_000, 50, 100)  # tables of words hold no cycles, and walking them is slow
    _OWNER = owner
    _HELD.clear()
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):  # only glibc can hand the memory back
        ctypes.CDLL(None).malloc_trim(0)


def cached(make: Callable, *args):
    """make(*args), once per Python worker."""
    key = (make, args)
    if key not in _HELD:
        _HELD[key] = make(*args)
    return _HELD[key]


ARROW_BYTES, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def _bytes(value: str) -> int:
    """Bytes of a Spark size such as 64MB; no limit (or none that can be read) is very many."""
    units = {"": 1, "b": 1, "k": 10, "kb": 10, "m": 20, "mb": 20, "g": 30, "gb": 30}
    digits = value.rstrip("bBkKmMgG")
    unit = value[len(digits) :].lower()
    if not digits.isdigit() or int(digits) <= 0 or unit not in units:
        return 1 << 62
    return int(digits) << (0 if units[unit] == 1 else units[unit])


def row_slices(column: pa.Array, n_bytes: int) -> Iterator[tuple[int, int]]:
    """(first row, rows) of portions of a column of about that many bytes, one row at least."""
    sizes = pc.cumulative_sum(pc.fill_null(pc.binary_length(column), 0).cast(pa.int64())).to_numpy(zero_copy_only=False)
    at = 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + n_bytes, "right")))
        yield at, end - at
        at = end


def ship(spark: SparkSession) -> None:
    """Workers import this package: its parent folder goes into their PYTHONPATH, beside whatever
    the cluster has set up (--py-files or an installed package)."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH"), root) if x)
    # Rows of long texts: an Arrow batch is cut by bytes too, not only by its 10,000 rows.
    if _bytes(spark.conf.get(ARROW_BYTES)) > BATCH_BYTES:
        spark.conf.set(ARROW_BYTES, str(BATCH_BYTES))


def map_batches(df: DataFrame, run: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str, keep: bool = True) -> DataFrame:
    """mapInArrow batch by batch; schema: of the new columns, or with keep=False of all. A column that has the name of a
    new one is replaced, as withColumn does."""
    ship(df.sparkSession)
    out = T._parse_datatype_string(schema)
    if keep:
        df = df.select(*others(df, out.names))
        out = T.StructType([*df.schema.fields, *out.fields])

    owner = run.__module__

    def each(batches):
        hold_only(owner)
        for batch in batches:
            yield from run(batch)

    return df.mapInArrow(each, out)
