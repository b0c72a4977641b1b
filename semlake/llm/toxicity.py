"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the n-grams of 3 to 5 bytes of a document's distinct words (runs of ASCII letters, digits
and bytes above 0x7F, A-Z lower-cased, with a border mark on both sides), hashed into 2**18
places; a feature counts the distinct words that hold it. For each place the log ratio of its smoothed shares
among toxic and other labelled documents scales the feature (zero if within SIGNIFICANT standard errors); a logistic regression on the scaled
features, divided by the root of the number of distinct words, gives the weights.

The ratios and the class shares come from all labelled training documents, summed in the tasks
before a shuffle of at most 2**18 places. The regression is fitted on the driver on a bounded sample: of each
class the TRAIN_ROWS // 2 labelled doc_ids of the table with the least hash, each by one of its rows; its intercept is then moved to the
class shares of all labels. Scores are computed in one pass without a shuffle; the model is 1 MB.

Defined results: null and empty texts and texts without words get the score of the intercept; a
doc_id that is labelled more than once is toxic if any label says so; null labels and null doc_ids in labels
are ignored; documents without a label are scored like others; with labels of one class only, or none, every score is the smoothed
class share (toxic + 0.5) / (labels + 2); repeated rows are answered one by one; an empty table gives an
empty result; other columns are carried through, but for those
named like the new ones, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from semlake.llm.bytewords import ASCII_LOWER, IS_GAP, mix, slices, word_hashes, words
from semlake.llm.common import broadcast_within, hold_only, map_batches, ship, table

BITS, SIZES = 18, (3, 4, 5)
PLACES = 1 << BITS
#: Labelled documents that the regression is fitted on, at most; half of them from each class.
TRAIN_ROWS = 4000
STEPS, RATE, RIDGE, SCALE = 80, 0.02, 1e-3, 10.0
#: Ratios within so many standard errors of none are left out. Low enough for terms that few toxic documents hold.
SIGNIFICANT = 2.0


def features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, int, np.ndarray, np.ndarray]]:
    """For each slice of rows: its first and end row; pairs (row, distinct word); the number of distinct
    words; pairs (distinct word, place). Word numbers are the slice's own."""
    for row, end, data, offsets in slices(column):
        data = ASCII_LOWER[data]
        starts, lengths, first = words(data, offsets, IS_GAP)
        if not len(starts):
            none = np.zeros(0, np.int64)
            yield row, end, none, none, 0, none, none
            continue
        own, at, number = np.unique(word_hashes(data, starts, lengths), return_index=True, return_inverse=True)
        pairs = np.unique(np.repeat(np.arange(end - row), np.diff(first)) * len(own) + number)
        # The distinct words one after another, with a space on both sides.
        size = lengths[at] + 2
        ends = np.cumsum(size)
        total = int(ends[-1])
        place = np.arange(total) - np.repeat(ends - size, size)
        laid = data[np.clip(np.repeat(starts[at], size) + place - 1, 0, len(data) - 1)].astype(np.uint64)
        laid[ends - 1] = laid[ends - size] = 32
        word, left = np.repeat(np.arange(len(own)), size), np.repeat(size, size) - place
        grams, of, code = [], [], laid.copy()
        for n in range(2, max(SIZES) + 1):
            if total >= n:
                code[: total - n + 1] |= laid[n - 1 :] << np.uint64(8 * (n - 1))
            if n in SIZES:
                fits = left >= n
                of.append(word[fits])
                grams.append((mix(code[fits] * np.uint64(8) + np.uint64(n)) >> np.uint64(64 - BITS)).astype(np.int64))
        yield row, end, pairs // len(own), pairs % len(own), len(own), np.concatenate(of), np.concatenate(grams)


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_labels(labels: DataFrame) -> DataFrame:
    """(tx_id, tx_label) of the doc_ids that are not held out."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~is_held_out(F.col("doc_id")))
    return known.groupBy(F.col("doc_id").alias("tx_id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("tx_label"))


def class_counts(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Of each place, the distinct words that hold it, summed over the documents of either class."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_only(__name__)
        sums = np.zeros((2, PLACES))
        for batch in batches:
            label = batch.column("tx_label").to_numpy()
            for row, end, doc, word, n, of, place in features(batch.column("text")):
                toxic = label[row:end][doc] if n else doc
                for k in (0, 1):
                    sums[k] += np.bincount(place, np.bincount(word[toxic == k], minlength=n)[of], PLACES) if n else 0
        held = np.flatnonzero(sums.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(sums[0, held]), pa.array(sums[1, held])], names=["place", "other", "toxic"])

    ship(docs.sparkSession)
    sums = docs.select("text", "tx_label").mapInArrow(each, "place bigint, other double, toxic double")
    got = sums.groupBy("place").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic")).toArrow()  # at most PLACES rows
    out = np.zeros((2, PLACES))
    for k, name in enumerate(("other", "toxic")):
        out[k, got.column("place").to_numpy()] = got.column(name).to_numpy()
    return out[0], out[1]


def fit(texts: pa.Array, label: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of the places, the ratios included, and the intercept."""
    rows, places, counts, n_words = [], [], [], np.ones(len(label))
    for row, _, doc, word, n, of, place in features(texts):
        if not n:
            continue
        n_words[row : row + int(doc[-1]) + 1] = np.maximum(1, np.bincount(doc))
        order = np.argsort(of, kind="stable")
        order = order[ratio[place[order]] != 0]
        of, place = of[order], place[order]
        start = np.searchsorted(of, np.arange(n + 1))
        many = np.diff(start)[word]
        spot = np.arange(many.sum()) + np.repeat(start[word] - np.cumsum(many) + many, many)
        key, count = np.unique(np.repeat(doc, many) * PLACES + place[spot], return_counts=True)
        rows.append((key // PLACES + row).astype(np.int32))
        places.append((key % PLACES).astype(np.int32))
        counts.append(count.astype(np.float32))
    rows, places = np.concatenate(rows), np.concatenate(places)
    x = np.concatenate(counts) * ratio[places].astype(np.float32) * (SCALE / np.sqrt(n_words[rows])).astype(np.float32)
    w, b = np.zeros(PLACES), 0.0
    m, v, mb, vb = np.zeros(PLACES), np.zeros(PLACES), 0.0, 0.0
    for step in range(1, STEPS + 1):  # Adam over all rows
        p = 1 / (1 + np.exp(-np.clip(np.bincount(rows, x * w[places], len(label)) + b, -30, 30)))
        g = (p - label) / len(label)
        gw, gb = np.bincount(places, x * g[rows], PLACES) + RIDGE * w, g.sum()
        m, mb = 0.9 * m + 0.1 * gw, 0.9 * mb + 0.1 * gb
        v, vb = 0.999 * v + 0.001 * gw * gw, 0.999 * vb + 0.001 * gb * gb
        w -= RATE * m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        b -= 5 * RATE * mb / (1 - 0.9**step) / (np.sqrt(vb / (1 - 0.999**step)) + 1e-8)
    return w * ratio * SCALE, b


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> tuple[np.ndarray, float]:
    """(weights, intercept) from the labelled documents that are not held out."""
    marked = training_labels(labels)
    size = labels.count() * 32
    both = docs.select("doc_id", "text").join(broadcast_within(marked, size), F.col("doc_id") == F.col("tx_id")).select("tx_id", "tx_label", "text")
    shares = {r["tx_label"]: r["n"] for r in both.groupBy("tx_label").agg(F.count("*").alias("n")).collect()}
    other, toxic = shares.get(0, 0), shares.get(1, 0)
    if not (other and toxic):
        p = (toxic + 0.5) / (other + toxic + 2)
        return np.zeros(PLACES), float(np.log(p / (1 - p)))
    q, p = class_counts(both)
    ratio = np.log((p + 1) / (p + 1).sum()) - np.log((q + 1) / (q + 1).sum())
    ratio[np.abs(ratio) < SIGNIFICANT * np.sqrt(1 / (p + 1) + 1 / (q + 1))] = 0  # chance, given these counts
    there = both.select("tx_id", "tx_label").distinct()
    chosen = [r[0] for k in (0, 1) for r in there.where(F.col("tx_label") == k).orderBy(F.xxhash64("tx_id"), "tx_id").limit(most // 2).select("tx_id").collect()]
    ids = docs.sparkSession.createDataFrame([(i,) for i in chosen], "pick bigint")
    rows = both.join(F.broadcast(ids), F.col("tx_id") == F.col("pick")).groupBy("tx_id", "tx_label").agg(F.max("text").alias("text")).orderBy(F.xxhash64("tx_id"), "tx_id").toArrow()
    label = rows.column("tx_label").to_numpy().astype(float)
    weights, intercept = fit(rows.column("text").combine_chunks(), label, ratio)
    return weights, float(intercept + np.log(toxic / other) - np.log(label.sum() / (len(label) - label.sum())))


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """The documents with tx_score, 0 to 1."""
    held = docs.sparkSession.sparkContext.broadcast((model[0].astype(np.float32), model[1]))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        weights, intercept = held.value
        z = np.full(batch.num_rows, intercept)
        for row, end, doc, word, n, of, place in features(batch.column("text")):
            if n:
                each = np.bincount(of, weights[place], n)
                many = np.maximum(1, np.bincount(doc, minlength=end - row))
                z[row:end] += np.bincount(doc, each[word], end - row) / np.sqrt(many)
        out = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, "tx_score"])

    return map_batches(docs, run, "tx_score double")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), F.col("tx_score").alias("score"), (F.col("tx_score") >= 0.5).cast("int").alias("predicted"))
