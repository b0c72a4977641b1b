"""Embedding providers and rerankers behind an interface, a registry, and deterministic offline ones."""

from __future__ import annotations

import hashlib
import time
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semlake.functions import q15, text
from semlake.operators.common import checkpoint_path, cut, ship
from semlake.schemas import ModelConfig


class Provider(ABC):
    """Pickled to the executors; embed is called with at most max_request_size texts."""

    def __init__(self, config: ModelConfig):
        self.config = config

    @abstractmethod
    def embed(self, texts: list[str]) -> np.ndarray: ...


PROVIDERS: dict[str, type[Provider]] = {}


def provider(name: str) -> Callable[[type[Provider]], type[Provider]]:
    def add(cls: type[Provider]) -> type[Provider]:
        PROVIDERS[name] = cls
        return cls

    return add


@provider("hashing")
class HashingProvider(Provider):
    """Signed hashed word counts: the same vector for the same text, anywhere and without a network."""

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.config.dimension), np.float32)
        for i, t in enumerate(texts):
            for word in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                out[i, h % self.config.dimension] += 1.0 if h >> 63 else -1.0
        return out


def embed_texts(df: DataFrame, column: str, provider_: Provider, out: str = "vec", tries: int = 10, first_wait: float = 1.0) -> DataFrame:
    """The table with vectors: requests of bounded size within a partition, waits of 1, 2, 4, .. seconds after failures."""
    size = provider_.config.max_request_size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, size):
                batch = whole.slice(at, size)  # handed on with its vectors, so that one request is in Python objects at a time
                texts = batch.column(column).to_pylist()
                for attempt in range(tries):
                    try:
                        made = np.asarray(provider_.embed(texts), np.float32)
                        break
                    except Exception:
                        if attempt == tries - 1:
                            raise
                        time.sleep(first_wait * 2**attempt)
                vectors = pa.array(list(made), pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([*batch.columns, vectors], names=[*batch.schema.names, out])

    ship(df.sparkSession)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", `{out}` array<float>"
    return df.mapInArrow(run, schema)


def fill_vectors(candidates: DataFrame, vectors: DataFrame, provider_: Provider, force: bool = False) -> DataFrame:
    """(model, key, q) of candidates (key, text) that have a text but no vector yet (all with force)."""
    model = provider_.config.name
    todo = candidates.where(F.col("text").isNotNull()).dropDuplicates(["key"])
    if not force:
        todo = todo.join(vectors.where(F.col("model") == model).select("key"), "key", "left_anti")
    todo = todo.withColumn("text", text.apply_template(F.col("text"), provider_.config.templates["document"], "document"))
    out = embed_texts(todo.select("key", "text"), "text", provider_)
    vec = q15.l2_normalize(F.col("vec")) if provider_.config.normalize else F.col("vec")
    q = F.transform(q15.quantize(vec), lambda x: x.cast("smallint"))
    made = out.select(F.lit(model).alias("model"), "key", q.alias("q"))
    return cut(made, checkpoint_path(candidates.sparkSession))  # written once: later actions read it and ask no service again


def cached_embed(df: DataFrame, cache: DataFrame, provider_: Provider, now) -> tuple[DataFrame, DataFrame]:
    """(all rows with vec, new cache rows): live cache entries (model, text, vec, expires_at) are reused."""
    model = provider_.config.name
    live = cache.where((F.col("model") == model) & (F.col("expires_at") > now)).select("text", "vec")
    hit = df.join(live, "text")
    miss = df.join(live, "text", "left_anti")
    fresh = embed_texts(miss.select("text").distinct(), "text", provider_)
    fresh = cut(fresh, checkpoint_path(df.sparkSession))  # written once, as both results need it
    made = miss.join(fresh, "text")
    return hit.unionByName(made), fresh.select(F.lit(model).alias("model"), "text", "vec")


def premise_vectors(premises: DataFrame, cache: DataFrame, provider_: Provider) -> tuple[DataFrame, DataFrame]:
    """(premises with vec, new cache rows) of premises (proposition, is_global): each proposition is embedded at most once; vectors
    of global ones are kept for later batches, those of local ones serve this batch alone. cache (model, proposition, vec)."""
    model = provider_.config.name
    held = cache.where(F.col("model") == model).select("proposition", "vec")
    new = premises.join(held.select("proposition"), "proposition", "left_anti").groupBy("proposition").agg(F.bool_or("is_global").alias("keep"))
    made = cut(embed_texts(new, "proposition", provider_), checkpoint_path(premises.sparkSession))
    every = held.unionByName(made.select("proposition", "vec"))
    return premises.join(every, "proposition"), made.where("keep").select(F.lit(model).alias("model"), "proposition", "vec")


class Reranker(ABC):
    @abstractmethod
    def scores(self, query: str, documents: list[str]) -> list[float]: ...


class OverlapReranker(Reranker):
    """Share of the query's words in a document; offline and deterministic."""

    def scores(self, query: str, documents: list[str]) -> list[float]:
        words = set(query.lower().split())
        return [len(words & set(d.lower().split())) / max(1, len(words)) for d in documents]


def rerank(top: DataFrame, query: str, text_column: str, reranker: Reranker, top_n: int) -> DataFrame:
    """A ranked handful is scored in one request, as services expect, then cut by relevance."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches), ignore_index=True)
        if len(rows):
            yield rows.assign(score=reranker.scores(query, rows[text_column].tolist()))

    ship(top.sparkSession)
    base = [f for f in top.schema.fields if f.name != "score"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base) + ", score double"
    return top.select(*[f.name for f in base]).coalesce(1).mapInPandas(run, schema).orderBy(F.desc("score"), "key").limit(top_n)
