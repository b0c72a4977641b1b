"""Token counts of a unigram model by dynamic programming over a trie of pre-tokens.

The vocabulary is that of a public tokenizer; a piece's log probability follows from its rank by
Zipf's law, log p = -log(rank + SHIFT) - log(sum of 1 / (rank + SHIFT)). A pre-token is U+2581 and the characters up to the next space.
Its count is the number of pieces in its best segmentation; of equal scores the one with
fewer pieces counts. A character without a piece is one byte piece for each UTF-8 byte, each
with the least score in the vocabulary.

The distinct new pre-tokens of a slice of documents form a trie, kept as the sorted list: a
depth-first walk goes down and up along shared prefixes, and the forward score of a node (the
best score and its number of pieces for that prefix) is computed once, however many
pre-tokens pass through it. The terminal counts are stored and reused by the task; the store
is bounded and falls back to the pre-tokens of the slice at hand.

Defined results: null and empty texts have no pre-tokens and no tokens; n spaces in a row make n - 1
pre-tokens that are just U+2581; very long texts and pre-tokens are counted whole; repeated rows
are answered one by one; an empty table gives an empty result; other columns are carried through, but for those
named like the new ones, which are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from semlake.llm.common import cached, map_batches, table

SPACE, SHIFT = "▁", 2.7
#: Terminal counts that a task stores, and documents in a slice.
STORED, SLICE = 300_000, 500


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class TrieCounter:
    def __init__(self, model: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        kept = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        total = math.log(sum(1 / (rank + SHIFT) for rank in range(len(kept))))
        self.score = {sp.id_to_piece(i): -math.log(rank + SHIFT) - total for rank, i in enumerate(kept)}
        #: The longest piece that ends in a character, by its last two characters.
        self.reach: dict[str, int] = {}
        for piece in self.score:
            self.reach[piece[-2:]] = max(self.reach.get(piece[-2:], 1), len(piece))
        self.least = min(self.score.values())
        self.stored: dict[str, int] = {}

    def terminals(self, tokens: Iterable[str]) -> Iterator[tuple[str, int]]:
        """(pre-token, count) of distinct pre-tokens without their U+2581, by a walk of their trie."""
        score, reach, least = self.score, self.reach, self.least
        best, count = [0.0], [0]  # forward scores of the prefixes on the path from the root
        path = ""
        for token in sorted(SPACE + t for t in tokens):
            # Go up to the last node that both share.
            shared, most = 0, min(len(path), len(token))
            while shared < most and path[shared] == token[shared]:
                shared += 1
            del best[shared + 1 :], count[shared + 1 :]
            for end in range(shared + 1, len(token) + 1):
                char = token[end - 1]
                if char in score:
                    top, n = best[-1] + score[char], count[-1] + 1
                else:
                    n_bytes = len(char.encode("utf-8"))
                    top, n = best[-1] + n_bytes * least, count[-1] + n_bytes
                for start in range(max(0, end - reach.get(token[end - 2 : end], 1)), end - 1):
                    s = score.get(token[start:end])
                    if s is not None:
                        s += best[start]
                        if s > top or s == top and count[start] + 1 < n:
                            top, n = s, count[start] + 1
                best.append(top)
                count.append(n)
            path = token
            yield token[1:], count[-1]

    def count(self, texts: list[str]) -> list[tuple[int, int]]:
        """(pre-tokens, tokens) of each text."""
        words = [t.split(" ") if t else [] for t in texts]
        seen = set(chain.from_iterable(words))
        new = seen.difference(self.stored)
        if len(self.stored) + len(new) > STORED:
            self.stored = {w: self.stored[w] for w in seen.difference(new)}
        self.stored.update(self.terminals(new))
        known = self.stored.__getitem__
        return [(len(w), sum(map(known, w))) for w in words]


def count_tokens(docs: DataFrame, model: str | None = None) -> DataFrame:
    """The documents with tc_pretokens and tc_tokens."""
    model = model or default_model()

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        counter, text = cached(TrieCounter, model), batch.schema.get_field_index("text")
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            got = counter.count([t or "" for t in part.column(text).to_pylist()])
            more = [pa.array([x[i] for x in got], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*part.columns, *more], names=[*part.schema.names, "tc_pretokens", "tc_tokens"])

    return map_batches(docs, run, "tc_pretokens bigint, tc_tokens bigint")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_pretokens and n_tokens of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs).selectExpr("doc_id", "tc_pretokens AS n_pretokens", "tc_tokens AS n_tokens")
