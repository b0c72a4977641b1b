"""Cross-tokenizer alignment: which tokens of one vocabulary cover the same bytes as those of another, and how often.

Tokenizer A is a byte-level BPE that is given a space and the text, B a SentencePiece model that adds the space
itself. Both lists of tokens spell the same bytes. Places where tokens of both end cut them into groups; two tokens
whose ranges overlap are linked. An overlap holds no token's end inside, so links are the stretches between
neighbouring ends of either kind.

Texts are cut into *units*: a run of spaces and what follows up to the next run that comes after a character other than
white space. Neither tokenizer joins characters across such a cut (A's pattern takes white space with what follows
it, no piece of B goes on into U+2581, checked on loading), so both end a token there; a unit is aligned once and
looked up again as long as a worker remembers it.

1. Pair keys ``b << 32 | a`` in one int64. A task counts its units, weighs their pairs with it and adds them up by ``np.unique``.
2. Partial counts are sorted by key over all range partitions; runs of a key are summed, and each partition is written
   to the shared folder as a shard: a file of sorted keys and one of counts, and a row of its place, first key and
   the highest count of each B id in it (no more rows in all than B has ids, after their maximum).
3. Links find their counts by ``np.searchsorted`` in shards that are mapped into memory (on a shared
   folder that isn't a file system they are read instead, and the last few kept).

Defined results: texts that are null or empty, or that either tokenizer does not spell byte for byte, have no tokens (zeros and an
empty string) and add nothing to the counts; long texts are aligned whole; repeated rows count each; an empty table gives an
empty result; other columns are carried through, but for those named like the new ones, which are replaced.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from itertools import chain, pairwise
from typing import NamedTuple
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semlake.llm.common import cached, hold_only, map_batches, materialise, ragged, remove, row_slices, scratch, ship, table

SPACE = "▁"
#: White space before a space: texts without it are cut at every space. Otherwise cuts follow the second pattern.
UNEVEN, CUT = re.compile(r"\s "), re.compile(r"(?<=\S)(?= )")
#: Units that a worker remembers, bytes of their texts, and bytes of text that are worked on at once.
MEMORY, MEMORY_BYTES, STEP_BYTES = 500_000, 16 << 20, 1 << 20
#: Fixed value: how byte-level BPE of this kind cuts texts.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Units that are encoded as one text.
JOINED = 20_000
#: Shards that are kept when they can't be mapped.
OPEN = 16
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def default_models() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 itself, the rest from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Counts(NamedTuple):
    """Where the sorted counts lie, the first key of each shard, and the highest count of each B id."""

    folder: str
    names: list[str]
    first: np.ndarray
    best: np.ndarray


class Aligned(NamedTuple):
    """Units one after another: numbers of tokens, groups and links of each (zeros where ``good`` is false), and all pair keys."""

    good: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    keys: np.ndarray
    groups: pa.Array


class Aligner:
    """A's file gives its vocabulary, and that its ids are in the order of its merges (checked); tiktoken then encodes several times as
    fast as the library that the file is for, and the same (tests compare them)."""

    def __init__(self, model_a: str, model_b: str):
        import sentencepiece
        import tiktoken

        with open(model_a, encoding="utf-8") as f:
            file = json.load(f)
        model, of = file["model"], byte_alphabet()
        pre = file["pre_tokenizer"]
        if model["type"] != "BPE" or file["normalizer"] or (pre["type"], pre["add_prefix_space"], pre["use_regex"]) != ("ByteLevel", False, True):
            raise ValueError(f"{model_a} is not a byte-level BPE without normalisation")
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
        made = [model["vocab"][m] for m in merged]
        if made != sorted(set(made)):
            raise ValueError(f"{model_a}: ids are not in the order of merges")
        special = {t["content"] for t in file["added_tokens"]}  # their strings in a text are plain text
        ranks = {bytes(of[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
        self.a = tiktoken.Encoding(name="a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_a = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes_a[i] = token
        self.b = sp = sentencepiece.SentencePieceProcessor(model_file=model_b)
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("the model has pieces that go on into U+2581; texts can't be cut there")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array([*map(len, x)], np.int64) for x in (self.bytes_a, self.bytes_b))
        self.flat_a, self.flat_b = (np.frombuffer(b"".join(x), np.uint8) for x in (self.bytes_a, self.bytes_b))
        self.blank = sp.piece_to_id(SPACE)

    def units(self, text: str) -> list[str]:
        """The units of a space and the text, each without its first space."""
        text = " " + text
        return [u[1:] for u in CUT.split(text)] if UNEVEN.search(text) else text.split(" ")[1:]

    def _encode_a(self, units: list[str], size: np.ndarray, alone: int) -> tuple[np.ndarray, np.ndarray]:
        """A's ids of all units and their number in each. Units are joined as a text would hold them and told apart by their
        bytes; the last ``alone`` ones end in white space and are encoded by themselves."""
        n = len(units) - alone
        parts, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in range(0, n, JOINED):
            end = min(at + JOINED, n)
            ids = np.array(self.a.encode_ordinary(" " + " ".join(units[at:end])), np.int64)
            parts.append(ids)
            counts.append(np.diff(np.searchsorted(np.cumsum(self.size_a[ids]), np.cumsum(size[at:end]), "right"), prepend=0))
        for u in units[n:]:
            parts.append(np.array(self.a.encode_ordinary(" " + u), np.int64))
            counts.append(np.array([len(parts[-1])]))
        return np.concatenate(parts), np.concatenate(counts)

    def align(self, units: list[str], alone: int | None = None, groups: bool = True) -> Aligned:
        """alone: how many units at the end of the list end in white space; by default none is joined with others."""
        want = [b" " + u.encode() for u in units]
        size = np.fromiter(map(len, want), np.int64, len(units))
        ids_a, n_a = self._encode_a(units, size, len(units) if alone is None else alone)
        b = [x or [self.blank] for x in self.b.encode(units, num_threads=1)]
        n_b = np.fromiter(map(len, b), np.int64, len(units))
        ids_b = np.fromiter(chain.from_iterable(b), np.int64, int(n_b.sum()))
        # Units that both spell byte for byte.
        whole, good = np.frombuffer(b"".join(want), np.uint8), np.ones(len(units), bool)
        owner_a, owner_b = np.repeat(np.arange(len(units)), n_a), np.repeat(np.arange(len(units)), n_b)
        for ids, owner, sizes, flat in ((ids_a, owner_a, self.size_a, self.flat_a), (ids_b, owner_b, self.size_b, self.flat_b)):
            each = sizes[ids]
            spelt = np.bincount(owner, each, len(units)).astype(np.int64)
            good &= spelt == size
            got = flat[ragged((np.cumsum(sizes) - sizes)[ids], each)]
            fit = np.repeat(spelt == size, spelt)
            right = whole[np.repeat(spelt == size, size)] == got[fit]
            at = np.repeat(np.flatnonzero(spelt == size), size[spelt == size])
            good[at[~right]] = False
        if not good.all():
            ids_a, ids_b = ids_a[good[owner_a]], ids_b[good[owner_b]]
            n_a, n_b, size = n_a * good, n_b * good, size * good
        end_a, end_b = np.cumsum(self.size_a[ids_a]), np.cumsum(self.size_b[ids_b])
        # Ends of either kind, as marks on the bytes.
        mark = np.zeros(int(size.sum()) + 1, np.uint8)
        mark[end_a] = 1
        mark[end_b] |= 2
        ends = np.flatnonzero(mark)
        kind, unit_ends = mark[ends], np.cumsum(size)
        at_a, at_b = (np.cumsum(kind & k > 0) - (kind & k > 0) for k in (1, 2))  # the tokens over the bytes before each end
        both = kind == 3
        shared = ends[both]
        group_ends = np.concatenate([[0], np.searchsorted(shared, unit_ends, "right")])
        text = pa.array([], pa.string())
        if groups:
            joined = []
            for ids, at in ((ids_a, at_a), (ids_b, at_b)):
                offsets = np.concatenate([[0], at[both] + 1])
                joined.append(pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(ids).cast(pa.string())), ","))
            text = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(group_ends), pc.binary_join_element_wise(*joined, "|")), ";")
        n_links = np.diff(np.searchsorted(ends, unit_ends, "right"), prepend=0)
        return Aligned(good, n_a, n_b, np.diff(group_ends), n_links, ids_b[at_b] << 32 | ids_a[at_a], text)


class Units:
    """The units that a worker remembers, by number; ``texts`` says whether their groups are kept as text."""

    texts = False

    def __init__(self, model_a: str, model_b: str):
        self.aligner = cached(Aligner, model_a, model_b)
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.bytes, self.good = 0, np.zeros(0, bool)

    def full(self, new: int) -> bool:
        return bool(self.number) and (len(self.number) + new > MEMORY or self.bytes > MEMORY_BYTES)

    def learn(self, units: set[str]) -> None:
        alone = [u for u in units if not u or u[-1].isspace()]
        units = [*units.difference(alone), *alone]
        got = self.aligner.align(units, len(alone), self.texts)
        self.number.update(zip(units, range(len(self.number), len(self.number) + len(units)), strict=True))
        self.bytes += sum(map(len, units))
        self.good = np.concatenate([self.good, got.good])
        self.add(got)

    def places(self, words: list[str], cut: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The units' numbers, where each text begins in them (and the end), and whether all of a text's units are good."""
        number = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        size = np.fromiter(map(len, cut), np.int64, len(cut))
        fine = np.bincount(np.repeat(np.arange(len(cut)), size), ~self.good[number], len(cut)) == 0
        return number, np.concatenate([[0], np.cumsum(size)]), fine


class PairUnits(Units):
    """With the pair keys of each unit."""

    def clear(self) -> None:
        super().clear()
        self.keys, self.n_links = [], []

    def add(self, got: Aligned) -> None:
        self.keys.append(got.keys)
        self.n_links.append(got.n_links)

    def weighed(self, seen: np.ndarray) -> Iterator[pa.RecordBatch]:
        """(key, n) for units that were seen so often."""
        if len(seen):
            keys, back = np.unique(np.concatenate(self.keys), return_inverse=True)
            n = np.bincount(back, np.repeat(seen, np.concatenate(self.n_links)), len(keys)).astype(np.int64)  # exact below 2**53
            yield pa.RecordBatch.from_arrays([pa.array(keys[n > 0]), pa.array(n[n > 0])], names=["key", "n"])


class CountedUnits(Units):
    """With the six numbers of each unit and its groups as text."""

    folder, texts = "", True

    def use(self, counts: Counts) -> None:
        if counts.folder != self.folder:
            self.clear()
            self.folder, self.shards, self.best = counts.folder, Shards(*counts[:3]), counts.best

    def clear(self) -> None:
        super().clear()
        self.numbers, self.groups = np.zeros((len(COLUMNS), 0), np.int64), []

    def add(self, got: Aligned) -> None:
        keys, back = np.unique(got.keys, return_inverse=True)
        n = self.shards.get(keys)
        top = (n == self.best[keys >> 32]) & (n > 0)
        owner, sums = np.repeat(np.arange(len(got.good)), got.n_links), np.zeros(len(got.good), np.int64)
        np.add.at(sums, owner, n[back])
        best = np.bincount(owner, top[back], len(sums)).astype(np.int64)
        self.numbers = np.concatenate([self.numbers, [got.n_a, got.n_b, got.n_groups, got.n_links, best, sums]], axis=1)
        self.groups += [g.encode() for g in got.groups.to_pylist()]


class Store:
    """The shared folder as workers reach it: a file system, or what pyarrow can open."""

    def __init__(self, folder: str):
        url = urlparse(folder)
        self.local = url.scheme in ("", "file")
        self.files, self.path = (fs.LocalFileSystem(), url.path) if self.local else fs.FileSystem.from_uri(folder)

    def write(self, name: str, blocks: Iterator[np.ndarray]) -> int:
        """Under another name first, so that a lost task leaves nothing under this one."""
        part, n = f"{self.path}/_{uuid.uuid4().hex}", 0
        with self.files.open_output_stream(part) as out:
            for block in blocks:
                out.write(np.ascontiguousarray(block, "<i8").tobytes())
                n += len(block)
        self.files.move(part, f"{self.path}/{name}")
        return n

    def read(self, name: str) -> np.ndarray:
        if self.local:
            return np.frombuffer(pa.memory_map(f"{self.path}/{name}").read_buffer(), "<i8")
        with self.files.open_input_file(f"{self.path}/{name}") as f:
            return np.frombuffer(f.read(), "<i8")


class Shards:
    """Sorted keys and their counts in files; ``first`` holds the first key of each."""

    def __init__(self, folder: str, names: list[str], first: np.ndarray):
        self.store, self.names, self.first = Store(folder), names, first
        self.open: OrderedDict[int, tuple[np.ndarray, np.ndarray]] = OrderedDict()

    def shard(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        if i not in self.open:
            self.open[i] = (self.store.read(f"{self.names[i]}.keys"), self.store.read(f"{self.names[i]}.counts"))
            if not self.store.local and len(self.open) > OPEN:
                self.open.popitem(last=False)
        return self.open[i]

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The counts of sorted keys, 0 for those that are not there."""
        out = np.zeros(len(keys), np.int64)
        cuts = np.concatenate([np.searchsorted(keys, self.first), [len(keys)]])
        for i in np.flatnonzero(np.diff(cuts)).tolist():
            held, counts = self.shard(i)
            part = keys[cuts[i] : cuts[i + 1]]
            at = np.minimum(np.searchsorted(held, part), len(held) - 1)
            out[cuts[i] : cuts[i + 1]] = np.where(held[at] == part, counts[at], 0)
        return out


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[str]]]:
    for at, n in row_slices(batch.column("text"), STEP_BYTES):
        yield at, n, [t or "" for t in batch.column("text").slice(at, n).to_pylist()]


def pair_counts(docs: DataFrame, models: tuple[str, str] | None = None) -> DataFrame:
    """(key, n): partial counts of the id pairs that are linked, added up within each task."""
    models, owner = models or default_models(), __name__
    ship(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_only(owner)
        held = cached(PairUnits, *models)
        seen = np.zeros(len(held.number), np.int64)
        for batch in batches:
            for _, _, texts in _texts(batch):
                cut = [held.aligner.units(t) if t else [] for t in texts]
                words = list(chain.from_iterable(cut))
                new = set(words).difference(held.number)
                if held.full(len(new)):
                    yield from held.weighed(seen)
                    held.clear()
                    seen, new = seen[:0], set(words)
                if new:
                    held.learn(new)
                    seen = np.concatenate([seen, np.zeros(len(new), np.int64)])
                number, bounds, fine = held.places(words, cut)
                seen += np.bincount(number[np.repeat(fine, np.diff(bounds))], minlength=len(seen))
        yield from held.weighed(seen)

    return docs.select("text").mapInArrow(each, "key bigint, n bigint")


def sorted_counts(partial: DataFrame, folder: str, ids_b: int) -> Counts:
    """Sort partial counts (key, n) by key over all partitions, add runs up, and write a shard from each partition."""
    spark = partial.sparkSession
    ship(spark)
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(p)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, best = [], [], np.zeros(ids_b, np.int64)
        for batch in batches:
            key, n = (batch.column(c).to_numpy() for c in ("key", "n"))
            if not len(key):
                continue
            new = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
            n = np.add.reduceat(n, new)
            key = key[new]
            if keys and keys[-1][-1] == key[0]:
                counts[-1][-1] += n[0]
                key, n = key[1:], n[1:]
            if len(key):
                keys.append(key)
                counts.append(n)
        rows = [[], [], [], []]
        if keys:
            store, name = Store(folder), f"{int(keys[0][0]):016x}"
            store.write(f"{name}.keys", iter(keys))
            store.write(f"{name}.counts", iter(counts))
            for key, n in zip(keys, counts, strict=True):
                np.maximum.at(best, key >> 32, n)
            some = np.flatnonzero(best)
            rows = [[name], [int(keys[0][0])], [some], [best[some]]]
        lists = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.string()), pa.array(rows[1], pa.int64()), pa.array(rows[2], lists), pa.array(rows[3], lists)], names=["name", "first", "b", "top"])

    ordered = partial.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "key").sortWithinPartitions("key")
    got = materialise(ordered.mapInArrow(each, "name string, first bigint, b array<bigint>, top array<bigint>"), f"{folder}/index")
    places = got.select("name", "first").orderBy("first").collect()  # a row for each partition
    tops = got.select(F.explode(F.arrays_zip("b", "top")).alias("x")).groupBy("x.b").agg(F.max("x.top").alias("top")).toArrow()  # at most ids_b rows
    best = np.zeros(ids_b, np.int64)
    best[tops.column("b").to_numpy()] = tops.column("top").to_numpy()
    return Counts(folder, [r["name"] for r in places], np.array([r["first"] for r in places], np.int64), best)


def count_pairs(docs: DataFrame, path: str, models: tuple[str, str] | None = None) -> Counts:
    """The corpus-wide counts of the documents' id pairs, as shards below path."""
    models = models or default_models()
    partial = materialise(pair_counts(docs, models), f"{path}/partial")
    ids_b = len(cached(Aligner, *models).bytes_b)
    out = sorted_counts(partial, f"{path}/shards", ids_b)
    remove(docs.sparkSession, f"{path}/partial")
    return out


def align_documents(docs: DataFrame, counts: Counts, models: tuple[str, str] | None = None, digest: bool = False) -> DataFrame:
    """The documents with al_n_a, al_n_b, al_n_groups, al_n_links, al_n_best, al_count_sum and al_groups, such as ``a1,a2|b1;a3|b2,b3``
    (its SHA-256 if digest is set)."""
    models = models or default_models()
    held_counts = docs.sparkSession.sparkContext.broadcast(counts)
    names = [f"al_{c}" for c in COLUMNS]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        held = cached(CountedUnits, *models)
        held.use(held_counts.value)
        for at, n, texts in _texts(batch):
            cut = [held.aligner.units(t) if t else [] for t in texts]
            words = list(chain.from_iterable(cut))
            new = set(words).difference(held.number)
            if held.full(len(new)):
                held.clear()
                new = set(words)
            if new:
                held.learn(new)
            number, bounds, fine = held.places(words, cut)
            total = np.concatenate([np.zeros((len(COLUMNS), 1), np.int64), np.cumsum(held.numbers[:, number], axis=1)], axis=1)
            sums = (total[:, bounds[1:]] - total[:, bounds[:-1]]) * fine
            sides = zip(pairwise(bounds.tolist()), fine.tolist(), strict=True)
            text = [b";".join([held.groups[i] for i in number[a:b].tolist()]) if ok else b"" for (a, b), ok in sides]
            text = [hashlib.sha256(x).hexdigest() if x else "" for x in text] if digest else [x.decode() for x in text]
            columns = [*batch.slice(at, n).columns, *map(pa.array, sums), pa.array(text, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *names, "al_groups"])

    return map_batches(docs, run, ", ".join([*(f"{c} bigint" for c in names), "al_groups string"]))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = align_documents(docs, count_pairs(docs, scratch(spark)), digest=True)
    return out.selectExpr("doc_id", *(f"al_{c} AS {c}" for c in COLUMNS), "al_groups AS groups_sha256")
