"""Embedding through a service that takes batches and answers later: submitted once, polled, and resumed after a crash.

The store keeps what has been planned (``batch_items``: which text is where in which batch) and how far each batch is (``batches``:
planned, submitted, failed, done). A batch is submitted under its own name, which a service must answer with the same
ticket if it is given again; so a run that is lost after a submission and before its commit submits nothing twice.
Vectors and the state of their batch are committed together."""

from __future__ import annotations

import time
import uuid
from abc import ABC, abstractmethod
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semlake.functions import q15
from semlake.operators.common import checkpoint_path, cut, remove, ship
from semlake.sources.store import Store

BATCHES = "batch string, state string, ticket string, tries int, tokens bigint"
ITEMS = "key binary, batch string, text string"


class BatchService(ABC):
    """What a service offers; its objects travel to the tasks."""

    @abstractmethod
    def submit(self, name: str, texts: list[str]) -> str:
        """The ticket of a batch; the same for the same name."""

    @abstractmethod
    def poll(self, ticket: str) -> str:
        """running, failed or done."""

    @abstractmethod
    def fetch(self, ticket: str) -> tuple[np.ndarray, int]:
        """The vectors of a batch that is done, in the order of its texts, and the tokens it took."""


class TimedOut(RuntimeError):
    """Batches are still running; another run goes on with them."""


class Failed(RuntimeError):
    """Batches failed too often."""


def plan(store: Store, texts: DataFrame, vectors: str, size: int) -> int:
    """Deal texts (key, text) that have neither a vector nor a place in a batch into new batches of about ``size``; returns their number."""
    todo = texts.where(F.col("text").isNotNull()).dropDuplicates(["key"])
    for table in (vectors, "batch_items"):
        if store.version(table):
            todo = todo.join(store.read(table).select("key"), "key", "left_anti")
    todo = cut(todo.select("key", "text"), checkpoint_path(texts.sparkSession))
    n = todo.count()
    if not n:
        return 0
    run, count = uuid.uuid4().hex[:12], max(1, -(-n // size))
    dealt = todo.withColumn("batch", F.concat(F.lit(f"{run}-"), F.pmod(F.xxhash64("key"), F.lit(count)))).select("key", "batch", "text")
    new = dealt.select("batch").distinct().select("batch", F.lit("planned").alias("state"), F.lit(None).cast("string").alias("ticket"), F.lit(0).alias("tries"), F.lit(0).cast("bigint").alias("tokens"))
    store.change().upsert("batch_items", dealt).upsert("batches", new, ("batch",)).commit()
    return n


def _in_state(store: Store, state: str) -> DataFrame:
    return store.read("batches").where(F.col("state") == state)


def submit(store: Store, service: BatchService) -> None:
    """Submit what is planned, a batch a group, and commit the tickets."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("key")
        name = f"{rows['batch'].iloc[0]}-{rows['tries'].iloc[0]}"
        return pd.DataFrame({"batch": rows["batch"].iloc[:1], "state": "submitted", "ticket": service.submit(name, rows["text"].tolist()), "tries": rows["tries"].iloc[:1], "tokens": 0})

    path = checkpoint_path(store.spark)
    ship(store.spark)
    todo = store.read("batch_items").join(_in_state(store, "planned").select("batch", "tries"), "batch")
    sent = cut(todo.groupBy("batch").applyInPandas(one, BATCHES), path)
    if not sent.isEmpty():
        store.upsert("batches", sent, ("batch",))
    remove(store.spark, path)


def collect(store: Store, service: BatchService, vectors: str, model: str, normalize: bool = True, most_tries: int = 3) -> int:
    """Ask after every submitted batch once: vectors of those that are done are committed with their state, those that failed are planned
    again or, after most_tries, marked. Returns the number still running."""
    spark, path = store.spark, checkpoint_path(store.spark)
    ship(spark)

    def ask(batches):
        for rows in batches:
            yield rows.assign(state=[service.poll(t) for t in rows["ticket"]])

    asked = cut(_in_state(store, "submitted").repartition("batch").mapInPandas(ask, BATCHES), f"{path}/asked")

    def load(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("key")
        made, tokens = service.fetch(rows["ticket"].iloc[0])
        if len(made) != len(rows):
            raise ValueError(f"{len(made)} vectors for {len(rows)} texts in batch {rows['batch'].iloc[0]}")
        return pd.DataFrame({"key": rows["key"], "batch": rows["batch"], "vec": np.asarray(made, np.float32).tolist(), "tokens": int(tokens)})

    done = store.read("batch_items").join(asked.where("state = 'done'").select("batch", "ticket"), "batch")
    got = cut(done.groupBy("batch").applyInPandas(load, "key binary, batch string, vec array<float>, tokens bigint"), f"{path}/got")
    vec = q15.l2_normalize(F.col("vec")) if normalize else F.col("vec")
    q = F.transform(q15.quantize(vec), lambda x: x.cast("smallint"))
    tokens = got.groupBy("batch").agg(F.first("tokens").alias("_tokens"))
    after = asked.where("state in ('done', 'failed')").join(tokens, "batch", "left").withColumn("tokens", F.coalesce("_tokens", "tokens")).drop("_tokens")
    after = after.withColumn("tries", F.col("tries") + (F.col("state") == "failed").cast("int"))
    after = after.withColumn("state", F.when((F.col("state") == "failed") & (F.col("tries") < most_tries), "planned").otherwise(F.col("state")))
    after = cut(after, f"{path}/after")
    if not after.isEmpty():
        change = store.change().upsert("batches", after, ("batch",))
        if not got.isEmpty():
            change.upsert(vectors, got.select(F.lit(model).alias("model"), "key", q.alias("q")))
        change.commit()
    running = asked.where("state = 'running'").count()
    remove(spark, path)
    return running


def run(store: Store, texts: DataFrame, service: BatchService, vectors: str, model: str, size: int = 1000, confirm: Callable[[int], bool] | None = None, most_polls: int = 360, wait: float = 10.0, most_tries: int = 3) -> dict:
    """Embed what has no vector yet and return counts and tokens. What an earlier run has submitted is only polled. confirm is asked with the
    number of new texts before anything is planned."""
    todo = texts.where(F.col("text").isNotNull()).select("key", "text")
    if confirm is not None and not confirm(todo.count()):
        return {"planned": 0, "done": 0, "tokens": 0}
    planned = plan(store, todo, vectors, size)
    if not store.version("batches"):
        return {"planned": 0, "done": 0, "tokens": 0}
    for turn in range(most_polls):
        submit(store, service)
        running = collect(store, service, vectors, model, most_tries=most_tries)
        if not running and _in_state(store, "planned").isEmpty():
            break
        if turn + 1 < most_polls:
            time.sleep(wait)
    else:
        raise TimedOut(f"{running} batches are still running after {most_polls} polls")
    if (bad := _in_state(store, "failed").select("batch").first()) is not None:
        raise Failed(f"batch {bad[0]} failed {most_tries} times")
    total = _in_state(store, "done").agg(F.count("*").alias("n"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("t")).first()
    return {"planned": planned, "done": total["n"], "tokens": total["t"]}
