"""Tables of the engine: explicit schemas, the kinds dimension and per-model settings."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

SCHEMA_VERSION, VECTOR_FORMAT = "2", "q15"

RECORDS = (
    "key binary, kind int, name string, expr string, interpretation string, "
    "provenance struct<template_uk:binary,locale_uk:binary,qualifier:string>, "
    "constituents array<struct<name:string,hash:binary>>, experience string, goal_patterns array<string>"
)
MODULE_STATUS = ("key binary, input_tokens bigint, cache_creation_tokens bigint, cache_read_tokens bigint, output_tokens bigint, cost_usd double, finished boolean, model string")
VECTORS = ("model string, key binary, q array<smallint>")
EMBED_STATUS = ("model string, key binary, finished boolean, total_tokens bigint")
MODULE_NAMES = ("hash binary, name string, ts timestamp")

THEORY, CONSTANT, THEOREM, TYPE, CLASS, LOCALE, COLLECTION, METHOD, EXPERIENCE = range(9)
INTRODUCTION, ELIMINATION, INDUCTION, CASE_SPLIT = 0x12, 0x22, 0x32, 0x42
RULE_KINDS = (INTRODUCTION, ELIMINATION, INDUCTION, CASE_SPLIT)

# Labels and plural phrases of the kinds.
KINDS = [
    (THEORY, "theory", None),
    (CONSTANT, "constant", "constants"),
    (THEOREM, "lemma", "theorems"),
    (TYPE, "type", "types"),
    (CLASS, "typeclass", "type classes"),
    (LOCALE, "locale", "locales"),
    (COLLECTION, "named theorem bundles", "theorem collections"),
    (METHOD, "proof method", "proof methods"),
    (EXPERIENCE, "experience", None),
    (INTRODUCTION, "introduction rule", "inference rules"),
    (ELIMINATION, "elimination rule", "inference rules"),
    (INDUCTION, "induction rule", "inference rules"),
    (CASE_SPLIT, "case-split rule", "inference rules"),
]


def kinds_table(spark: SparkSession) -> DataFrame:
    rows = [(k, label, phrase, k in RULE_KINDS) for k, label, phrase in KINDS]
    return spark.createDataFrame(rows, "kind int, label string, phrase string, is_rule boolean")


@dataclass(frozen=True)
class ModelConfig:
    """Settings of one embedding model; ``templates`` by role."""

    name: str
    dimension: int
    default_score: float = 0.3
    default_local_score: float = 0.5
    normalize: bool = True
    max_request_size: int = 256
    templates: dict[str, str] = field(default_factory=lambda: {"query": "{text}", "document": "{text}"})

    def __post_init__(self):
        if not self.dimension or self.dimension <= 0:
            raise ValueError(f"model {self.name!r} needs a dimension")
