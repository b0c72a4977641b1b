"""Exact SentencePiece BPE encoding by backtracking, and decoding.

The encoding of a text is the one sequence of pieces in which each adjacent pair is
*compatible*: merging the characters of both gives that very pair again. It is found from left to
right. An Aho-Corasick automaton of the pieces, read from their last character to their first, runs once over the texts from their end;
the longest match that ends where it stands is the longest piece that begins there. If the longest does not fit the piece before it, the next shorter prefix piece is tried; at a dead
end the position is marked in a bitfield of failed positions and the last piece is taken back.
Each position fails at most once, so the work is linear in the text. Many texts take their steps together, as NumPy
arrays of positions and piece numbers; the last few are finished one by one.

Two pieces are compatible if no merge across their border comes before the merges that made them. That is decided on
piece numbers: the last merge on either side of the border is undone, the later one
first, and each time the two pieces at the border are looked up; should they merge earlier than what was undone
last, merging anew takes another way. Answers are kept in a table of fixed size.

No piece of the model crosses from another character into U+2581 (checked on loading), so
a text is cut there and each distinct cut is encoded once per task; the memory of cuts is bounded.
Characters without a piece become byte pieces, as the library does.

Defined results: null text is empty and encodes to the end id alone; empty and very long
texts are encoded whole; repeated rows are answered one by one; an empty table gives an
empty result; other columns are carried through, but for those named like the new ones, which are replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from semlake.llm.common import IntTable, Memory, WordIds, cached, map_batches, row_slices, table

SPACE = "▁"
CUTS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Bytes of text that are looked up together, and characters of new cuts that are encoded together.
STEP_BYTES, STEP_CHARS = 2 << 20, 1 << 20
#: Distinct cuts that a task remembers before it starts afresh.
MEMORY = 600_000
#: Places of the table of pairs (a power of two), and texts that are left to be finished one by one.
PAIR_BITS, FEW = 18, 48


def default_model() -> str:
    """The public model; found where the code runs, never copied into the repository."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def remerge(text: str, score: dict[str, float]) -> tuple[list[str], tuple[str, str]]:
    """Merge the characters of a short text: the best-scored adjacent pair first, the leftmost of equals.
    Returns what remains, and the two parts of the last merge."""
    parts, last = list(text), ("", "")
    while True:
        best, at = None, -1
        for i in range(len(parts) - 1):
            s = score.get(parts[i] + parts[i + 1])
            if s is not None and (best is None or s > best):
                best, at = s, i
        if at < 0:
            return parts, last
        last = (parts[at], parts[at + 1])
        parts[at : at + 2] = [parts[at] + parts[at + 1]]


class Automaton:
    """Aho-Corasick over sequences of numbers below ``width``, as arrays: edges, failure links and, for each state, the
    longest pattern that ends in it. Windows of the text advance together."""

    WINDOW = 64

    def __init__(self, patterns: list[list[int]], width: int):
        edges: dict[int, int] = {}
        depth, ends = [0], {}
        for number, pattern in enumerate(patterns):
            state = 0
            for x in pattern:
                if (after := edges.get(state * width + x)) is None:
                    after = edges[state * width + x] = len(depth)
                    depth.append(depth[state] + 1)
                state = after
            ends[state] = number
        self.width, self.reach = width, max(depth)
        key, state = np.array(list(edges), np.int64), np.array(list(edges.values()), np.int64)
        # From the root every number leads somewhere, to the root itself if nothing else.
        bare = np.setdiff1d(np.arange(width), key)
        self.edges = IntTable(np.append(key, bare), np.append(state, np.zeros(len(bare), np.int64)), -1)
        self.fail, self.out = np.zeros(len(depth), np.int64), np.full(len(depth), -1, np.int64)
        self.out[list(ends)] = list(ends.values())
        grows = np.zeros(len(depth), bool)
        grows[key // width] = True
        #: Where to go on from a state: itself, or the first of its failure links that has edges.
        self.resume = np.where(grows, np.arange(len(depth)), 0)
        level = np.array(depth)[state]
        for d in range(1, self.reach + 1):  # by depth: the links of shorter states are known
            now, (parent, x) = state[level == d], np.divmod(key[level == d], width)
            if d > 1:
                self.fail[now] = self.step(self.fail[parent], x)
            none = now[self.out[now] < 0]
            self.out[none] = self.out[self.fail[none]]
            stop = now[~grows[now]]
            self.resume[stop] = self.resume[self.fail[stop]]

    def step(self, state: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The states after reading x, by failure links where there is no edge."""
        after = self.edges.get(state * self.width + x)
        stuck = np.flatnonzero(after < 0)
        if len(stuck):
            state, x = state[stuck], x[stuck]
            while len(stuck):
                state = self.fail[state]
                found = self.edges.get(state * self.width + x)
                after[stuck] = found
                on = found < 0
                stuck, state, x = stuck[on], state[on], x[on]
        return after

    def longest(self, text: np.ndarray) -> np.ndarray:
        """At each place the longest pattern (read backwards) that begins there, -1 for none. A window also reads as much
        after its end as a pattern can reach."""
        n, w = len(text), self.WINDOW
        rows = -(-n // w)
        padded = np.full(rows * w + self.reach, self.width - 1, np.int64)
        padded[:n] = text
        best, state = np.full((w, rows), -1, np.int64), np.zeros(rows, np.int64)
        for at in range(w + self.reach - 2, -1, -1):
            state = self.step(state, padded[at : at + (rows - 1) * w + 1 : w])
            if at < w:
                best[at] = self.out[state]
            state = self.resume[state]
        return best.T.reshape(-1)[:n]


class BacktrackEncoder:
    """Pieces are numbered: characters first, then merged pieces, best score first. The number
    ``n`` stands for a character that is in no piece, -1 for no piece at all."""

    def __init__(self, model: str, memory: int = MEMORY):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=model)
        id_of, score = {}, {}
        for i in range(sp.get_piece_size()):
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)):
                piece = sp.id_to_piece(i)
                id_of[piece], score[piece] = i, sp.get_score(i)
        if any(SPACE in p.lstrip(SPACE) for p in id_of):
            raise ValueError("the model has pieces that cross into U+2581; texts can't be cut there")
        self.score, self.end = score, sp.eos_id()
        self.byte = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        chars = sorted(set(chain.from_iterable(id_of)))
        merges = {}
        for p in sorted((p for p in id_of if len(p) > 1), key=lambda p: -score[p]):
            parts, last = remerge(p, score)
            if len(parts) == 1:  # only pieces that merging their own characters gives back ever occur
                merges[p] = last
        self.pieces = [*chars, *merges]
        self.rank = rank = {p: i for i, p in enumerate(self.pieces)}
        self.n, self.leaves = n, leaves = len(rank), len(chars)
        # When a piece is merged: characters never, equal scores at once.
        scores = sorted({score[p] for p in merges}, reverse=True)
        place = dict(zip(scores, range(1, len(scores) + 1), strict=True))
        self.order = np.array([0] * leaves + [place[score[p]] for p in merges], np.int64)
        if any(self.order[rank[p]] < max(self.order[rank[x]] for x in m) for p, m in merges.items()):
            raise ValueError("pairs can't be checked from their ends: a piece is merged before its parts")
        self.left, self.right = (np.array([0] * leaves + [rank[m[k]] for m in merges.values()], np.int64) for k in (0, 1))
        pairs = {rank[p[:k]] * n + rank[p[k:]]: i for i, p in enumerate(self.pieces) for k in range(1, len(p)) if p[:k] in rank and p[k:] in rank}
        self.pair = IntTable(np.array(list(pairs), np.int64), self.order[list(pairs.values())], n)
        # Two more places at the end: the unknown character (n) and no piece (-1).
        self.length = np.array([*map(len, self.pieces), 1, 0], np.int64)
        shorter = [next((rank[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in rank), -1) for p in self.pieces]
        self.shorter = np.array([*shorter, -1, -1], np.int64)
        self.leaf = np.full(0x110000, leaves, np.int32)
        self.leaf[[ord(c) for c in chars]] = range(leaves)
        self.one = np.array([*(id_of.get(p, -1) for p in self.pieces), -1], np.int32)  # -1: byte pieces
        self.cut_lines = "\n" not in rank
        self.border = next(chr(c) for c in range(0x110000) if chr(c) not in rank)
        self.machine = Automaton([[rank[c] for c in reversed(p)] for p in self.pieces], leaves + 1)
        self.held_key, self.held_fit = np.full(1 << PAIR_BITS, -1, np.int64), np.zeros(1 << PAIR_BITS, bool)
        self.one_pair = Memory(lambda key: bool(self.fit(np.array([key // (n + 1)]), np.array([key % (n + 1)]))[0]), 1 << PAIR_BITS)
        self.store = WordIds(self._encode_keys, memory, self.end)

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """When each pair is merged; n where it never is."""
        return self.pair.get(a * self.n + b)

    def fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging anew gives each pair back, by undoing merges at the border, the later one first."""
        out = np.ones(len(a), bool)
        live = np.flatnonzero((a < self.n) & (b < self.n))  # unknown characters never merge
        a, b = a[live], b[live]
        limit = np.full(len(live), self.n)
        while len(live):
            clash = self.merged(a, b) < limit
            out[live[clash]] = False
            on = ~clash & (np.maximum(a, b) >= self.leaves)
            live, a, b = live[on], a[on], b[on]
            # Of equal merges the left one comes first: one across the border precedes an equal one on its right only.
            undo_a = self.order[a] > self.order[b]
            limit = np.where(undo_a, self.order[a], self.order[b] + 1)
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * (self.n + 1) + b
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        out = self.held_fit[slot]
        miss = np.flatnonzero(self.held_key[slot] != key)
        if len(miss):
            new, where = np.unique(key[miss], return_inverse=True)
            fits = self.fit(*np.divmod(new, self.n + 1))
            out[miss] = fits[where]
            self.held_key[slot[miss]], self.held_fit[slot[miss]] = key[miss], out[miss]
        return out

    def longest(self, text: str) -> np.ndarray:
        """The longest piece at each position."""
        best = self.machine.longest(self.leaf[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")])
        best[best < 0] = self.n
        return best

    def encode_cuts(self, cuts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts that are not empty, all stepping together, and the number of each."""
        text = self.border.join(cuts)
        best = self.longest(text)
        size = np.fromiter(map(len, cuts), np.int64, len(cuts))
        first = np.cumsum(size + 1) - size - 1
        chosen, back = np.zeros(len(text), np.int32), np.zeros(len(text) + 1, np.int64)
        taken, failed = np.zeros(len(text), bool), np.zeros(len(text) // 8 + 1, np.uint8)
        begin, stop = first, first + size
        at, piece = begin, best[begin]
        while len(at) > FEW:
            end = at + self.length[piece]
            ok = (piece >= 0) & (failed[end >> 3] >> (end & 7).astype(np.uint8) & 1 == 0)
            check = np.flatnonzero(ok & (at > begin))
            ok[check] = self.compatible(chosen[back[at[check]]].astype(np.int64), piece[check])
            put = at[ok]
            chosen[put], taken[put], back[end[ok]] = piece[ok], True, put
            piece[~ok] = self.shorter[piece[~ok]]
            at = np.where(ok, end, at)
            dead = np.flatnonzero(~ok & (piece < 0))
            if len(dead):  # mark the position and take the last piece back
                spot = at[dead]
                np.bitwise_or.at(failed, spot >> 3, np.uint8(1) << (spot & 7).astype(np.uint8))
                spot = back[spot]
                taken[spot] = False
                at[dead], piece[dead] = spot, self.shorter[chosen[spot]]
            on = np.flatnonzero(at < stop)
            fresh = np.flatnonzero(ok[on])
            at, piece, begin, stop = at[on], piece[on], begin[on], stop[on]
            piece[fresh] = best[at[fresh]]
        for a, b in zip(begin.tolist(), stop.tolist(), strict=True):
            where, what = self.backtrack(best[a:b].tolist())
            taken[a:b] = False
            taken[a + np.array(where)] = True
            chosen[a + np.array(where)] = what
        spot = np.flatnonzero(taken)
        ids = self.one[chosen[spot]]
        size = np.diff(np.searchsorted(spot, np.append(first, len(text) + 1)))
        if len(bare := np.flatnonzero(ids < 0)):  # characters without a piece
            codes = [text[i].encode("utf-8") for i in spot[bare].tolist()]
            more = np.fromiter(map(len, codes), np.int64, len(codes))
            cut = np.searchsorted(first, spot[bare], "right") - 1
            np.add.at(size, cut, more - 1)
            width = np.ones(len(ids), np.int64)
            width[bare] = more
            ids = np.repeat(ids, width)
            ids[ids < 0] = self.byte[np.frombuffer(b"".join(codes), np.uint8)]
        return ids, size

    def backtrack(self, best: list[int]) -> tuple[list[int], list[int]]:
        """The same for one text: positions and numbers of its pieces."""
        n, length, shorter, fits = len(best), self.length, self.shorter, self.one_pair
        failed = bytearray(n // 8 + 1)
        where: list[int] = []
        what: list[int] = []
        at = 0
        while at < n:
            piece = best[at]
            while True:
                end = at + int(length[piece])
                if not failed[end >> 3] >> (end & 7) & 1 and (not what or fits[what[-1] * (self.n + 1) + piece]):
                    where.append(at)
                    what.append(piece)
                    at = end
                    break
                piece = int(shorter[piece])
                while piece < 0:  # a dead end: mark it and take the last piece back
                    failed[at >> 3] |= 1 << (at & 7)
                    at, piece = where.pop(), int(shorter[what.pop()])
        return where, what

    def _encode_keys(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for what _keys gives, in portions of about STEP_CHARS characters."""
        cuts = [SPACE + k if SPACE not in k else k if k[0] == SPACE else k[:-1] for k in keys]
        reach = np.cumsum(np.fromiter(map(len, cuts), np.int64, len(cuts)))
        ends = np.append(np.flatnonzero(np.diff(reach // STEP_CHARS)) + 1, len(cuts)).tolist()
        out = [self.encode_cuts(cuts[a:b]) for a, b in zip([0, *ends], ends, strict=False)]
        return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])

    def _keys(self, text: str) -> list[str]:
        """The cuts of a text. A cut with one U+2581 before it is named without it; one that has none gets it at its end.
        A line feed is in no piece of a usual model, and then a cut of its own."""
        keys: list[str] = []
        text = self.sp.normalize(text)
        for i, line in enumerate(text.split("\n") if self.cut_lines else [text]):
            if i:
                keys.append("\n" + SPACE)
            head, *parts = line.split(SPACE)
            if "" in parts or not parts:  # not single spaces
                cuts = CUTS.findall(line)
                keys += [c + SPACE if c[0] != SPACE else c[1:] if c.count(SPACE) == 1 and len(c) > 1 else c for c in cuts]
            else:
                if head:
                    keys.append(head + SPACE)
                keys += parts
        return keys

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, the end id last in each, and where each text begins (and the end)."""
        return self.store.look_up([[*self._keys(t), None] for t in texts])

    def decode(self, ids: list[int]) -> str:
        return self.sp.decode(ids)


def encode_documents(docs: DataFrame, model: str | None = None, memory: int = MEMORY // 10) -> DataFrame:
    """The documents with sp_ids (array<int>, the end id last) and sp_decoded. memory: words that a task remembers; less
    than for the query, as ids and texts leave through the same worker and earlier stages have filled the JVM."""
    model = model or default_model()

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        coder = cached(BacktrackEncoder, model, memory)
        for at, n in row_slices(batch.column("text"), STEP_BYTES // 8):
            part = batch.slice(at, n)
            ids, bounds = coder.encode([t or "" for t in part.column("text").to_pylist()])
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids))
            more = [lists, pa.array([coder.decode(x) for x in lists.to_pylist()], pa.string())]
            yield pa.RecordBatch.from_arrays([*part.columns, *more], names=[*part.schema.names, "sp_ids", "sp_decoded"])

    return map_batches(docs, run, "sp_ids array<int>, sp_decoded string")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = default_model()

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        coder = cached(BacktrackEncoder, model)
        for at, size in row_slices(batch.column("text"), STEP_BYTES):
            part = batch.slice(at, size)
            ids, bounds = coder.encode([t or "" for t in part.column("text").to_pylist()])
            lists = pa.LargeListArray.from_arrays(pa.array(bounds), pa.array(ids).cast(pa.string()))
            ids_hash = [hashlib.sha256(x.as_buffer()).hexdigest() for x in pc.binary_join(lists, " ")]
            text_hash = [hashlib.sha256(coder.decode(ids[a:b].tolist()).encode("utf-8")).hexdigest() for a, b in pairwise(bounds.tolist())]
            columns = [part.column("doc_id"), pa.array(np.diff(bounds), pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_batches(docs, run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string", keep=False)
