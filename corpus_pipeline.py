"""From raw documents to token ids: toxicity, lines, near duplicates, benchmark passages, SentencePiece.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; all but the last
return the columns of documents. ``run`` writes each stage's result to the shared folder and reads it back, so that
a lost executor never costs more than the stage at hand.

Decisions: documents predicted toxic go; lines found in ten or more documents go, and n_chars is counted
anew; of each class of near duplicates (Jaccard 0.80 or more) the least doc_id stays; documents with a benchmark window go; what is left is
encoded with the end id. A stage is judged on its own input: line counts, for example, are
those of the documents that are not toxic.

Nulls, empty texts, repeated rows and empty tables: as the operators say. Extra columns are carried through all but the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semlake.llm import decontaminate as bench
from semlake.llm import lines, neardup, pieces, toxicity
from semlake.llm.common import materialise, remove, scratch, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where("tx_score < 0.5").select(docs.columns)


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(docs)
    new = {"text": F.when(F.col("text").isNotNull(), F.col("ll_text")), "n_chars": F.when(F.col("ll_dropped") > 0, F.length("ll_text").cast("long")).otherwise(F.col("n_chars"))}
    return out.select(*(new[c].alias(c) if c in new else F.col(c) for c in docs.columns))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.near_dedup(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = bench.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return out.where(F.size("dc_hit") == 0).select(docs.columns)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): what a trainer reads, and the text that the ids stand for."""
    out = pieces.encode_documents(docs.select("doc_id", "text"))
    return out.select("doc_id", F.size("sp_ids").cast("long").alias("n_tokens"), F.col("sp_ids").alias("ids"), F.col("sp_decoded").alias("decoded"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("line dedup", lines_stage),
    ("near dedup", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("sentencepiece", pieces_stage),
]

#: The classifier, MinHash and the tokenizer are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents"), scratch(spark)
    for i, (_, stage) in enumerate(STAGES):
        docs = materialise(stage(spark, docs, sf_dir), f"{path}/{i}")
        if i:  # nothing reads it any more
            remove(spark, f"{path}/{i - 1}")
    return docs
