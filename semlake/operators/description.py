"""Describing entries until all have an answer: rounds that are persisted, a bound on rounds without progress, and a check at the end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semlake.operators.common import checkpoint_path, cut, remove
from semlake.sources.store import Store

#: Rounds in a row without a new answer before it ends in an error.
MOST_STALLS = 10


class Unanswered(RuntimeError):
    """Entries that nobody described."""


def routed(answers: DataFrame, entries: DataFrame) -> DataFrame:
    """(key, answer) of answers (label, answer, seq): of a label's answers the last one that is not blank; labels without an entry
    are left out."""
    given = answers.where(F.trim(F.coalesce("answer", F.lit(""))) != "")
    last = given.groupBy("label").agg(F.max_by("answer", "seq").alias("answer"))
    return entries.select("key", "label").join(last, "label").select("key", "answer")


def describe(store: Store, entries: DataFrame, answerer: Callable[[DataFrame, int], DataFrame], table: str = "answers", most_stalls: int = MOST_STALLS) -> DataFrame:
    """(key, answer) for every entry (key, label, ..), also what earlier runs have answered.

    answerer gets the entries without an answer, as they were given, and the round; it returns (label, answer, seq) for as many as it likes. Each
    round is committed before the next, so a run that is lost goes on where it ended. A run that ends without an error has an answer for
    every entry. Entries whose label is used twice are refused, as no answer could be told apart."""
    path = checkpoint_path(entries.sparkSession)
    if (twice := entries.groupBy("label").agg(F.count_distinct("key").alias("n")).where("n > 1").select("label").first()) is not None:
        raise ValueError(f"two entries are called {twice[0]!r}")
    stalls = round_ = 0
    while True:
        held = store.read(table, "key binary, answer string") if store.version(table) else None
        left = entries if held is None else entries.join(held.select("key"), "key", "left_anti")
        left = cut(left, f"{path}/{round_}")
        if round_:
            remove(entries.sparkSession, f"{path}/{round_ - 1}")
        n = left.count()
        if not n:
            return held.join(entries.select("key"), "key", "left_semi") if held is not None else entries.select("key", F.lit(None).cast("string").alias("answer"))
        if stalls >= most_stalls:
            names = [r[0] for r in left.select("label").orderBy("label").limit(10).collect()]
            raise Unanswered(f"{n} entries have no answer after {stalls} rounds without a new one: {', '.join(map(str, names))}{' ..' if n > 10 else ''}")
        new = cut(routed(answerer(left, round_), left), f"{path}/new-{round_}")
        got = new.count()
        stalls = 0 if got else stalls + 1
        if got:
            store.upsert(table, new)
        remove(entries.sparkSession, f"{path}/new-{round_}")
        round_ += 1
