"""Semantic search as one call: candidates, quantized top-k, boosts, reranking, default scores, resolved records."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semlake.functions import q15, text
from semlake.operators import filters, index, topk
from semlake.providers import Provider, Reranker, embed_texts, fill_vectors, rerank
from semlake.schemas import EXPERIENCE, RULE_KINDS, THEOREM, ModelConfig, kinds_table

TASK = "Given a question, retrieve relevant {kinds}"
EXPERIENCE_TASK = "Given a goal, retrieve experiences that help to prove it"


@dataclass
class Domain:
    """Where to search: ``context`` (all candidates), ``extended`` (and more keys), ``restricted`` (these keys alone)."""

    mode: str = "context"
    keys: DataFrame | None = None


    @classmethod
    def tagged(cls, tag: int, keys: DataFrame | None = None) -> Domain:
        """By number, as callers over the wire send it: 0 context, 1 extended, 2 restricted."""
        return cls(("context", "extended", "restricted")[tag], keys)


@dataclass
class Answer:
    results: DataFrame  # key, kind, name, interpretation, score
    total: int
    warnings: list[str]

    def pairs(self) -> list[tuple[float, tuple[int, str]]]:
        """(score, (kind, name)) of the results, at most k of them, best first."""
        return [(r["score"], (r["kind"], r["name"])) for r in self.results.select("score", "kind", "name", "key").orderBy(F.desc("score"), "key").collect()]


class Searcher:
    """records and vectors as in schemas; candidates (key, kind, name, module, is_local, ord)."""

    def __init__(self, records: DataFrame, vectors: DataFrame, provider: Provider, reranker: Reranker | None = None):
        self.records, self.provider, self.reranker = records, provider, reranker
        self.config: ModelConfig = provider.config
        self.vectors = vectors.where(F.col("model") == self.config.name)

    def query_vector(self, query: str, task: str) -> list[int]:
        spark = self.records.sparkSession
        prompt = self.config.templates["query"].replace("{task}", text.template_task(task)).replace("{text}", query)
        row = embed_texts(spark.createDataFrame([(prompt,)], "t string"), "t", self.provider).select(q15.quantize(q15.l2_normalize(F.col("vec")))).first()
        return list(row[0])

    def document_texts(self, records: DataFrame) -> DataFrame:
        kinds = kinds_table(records.sparkSession).select("kind", "label")
        df = records.join(F.broadcast(kinds), "kind", "left")
        return df.select("key", text.document_text(F.col("kind"), F.col("label"), F.col("name"), F.col("expr"), F.col("interpretation"), F.col("goal_patterns")).alias("text"))

    def fill(self, candidates: DataFrame) -> None:
        """Vectors for candidates that have a document text but none yet."""
        wanted = self.records.join(candidates.select("key"), "key", "left_semi")
        self.vectors = self.vectors.unionByName(fill_vectors(self.document_texts(wanted), self.vectors, self.provider))

    def _candidates(self, candidates: DataFrame, kinds: Sequence[int], domain: Domain, names: Sequence[str], modules: Sequence[str]) -> DataFrame:
        out = topk.of_kinds(candidates, kinds)
        out = out.where(filters.name_contains(F.col("name"), names) & filters.modules_include(F.col("module"), modules))
        if domain.mode == "restricted":
            return filters.restricted(out, domain.keys).dropDuplicates(["key"])
        out = out.dropDuplicates(["key"])
        if domain.mode == "extended":
            extras = self.records.join(domain.keys.select("key"), "key", "left_semi").select("key", "kind", "name")
            extras = topk.without_shown_faces(topk.of_kinds(extras, kinds), out, THEOREM, RULE_KINDS)
            extras = extras.withColumns({"module": F.lit(None).cast("string"), "is_local": F.lit(False), "ord": F.lit(1 << 30)})
            out = out.unionByName(extras.select(out.columns), allowMissingColumns=True)
        return out

    def lookup(
        self, query: str, k: int, kinds: Sequence[int], candidates: DataFrame, domain: Domain | None = None, patterns: Sequence[str] = (),
        modules: Sequence[str] = (), names: Sequence[str] = (), loaded: DataFrame | None = None, auto_embed: bool = False,
    ) -> Answer:
        """The k best records. loaded (hash) switches experiences on, if their kind is asked for."""
        spark, warnings = self.records.sparkSession, []
        found = self._candidates(candidates, [x for x in kinds if x != EXPERIENCE], domain or Domain(), names, modules)
        fetch = 4 * k if self.reranker else k
        if auto_embed:
            self.fill(found)
        hits = None
        if EXPERIENCE in kinds and loaded is not None:
            exp = index.available(self.records.where(F.col("kind") == EXPERIENCE), loaded)
            if patterns:
                pats = F.array(*map(F.lit, patterns))
                hits = exp.select("key", filters.hit_rate(pats, F.array_join("goal_patterns", " ")).alias("hit")).where("hit > 0")
            else:
                hits = exp.select("key", F.lit(1.0).alias("hit"))
        total = found.count() + (hits.count() if hits is not None else 0)
        if k <= 0:
            return Answer(self.records.limit(0).select("key", "kind", "name", "interpretation", F.lit(0.0).alias("score")), total, warnings)
        state = topk.gather(found.select("key", "ord", "is_local"), self.vectors, "key", "q", self.config.dimension)
        wrong = state.where("state = 'skipped'").count()
        if wrong:
            warnings.append(f"{wrong} vectors of another length were skipped")
        entity = self.query_vector(query, TASK.replace("{kinds}", text.render_kinds(kinds)))
        top = topk.top_k(state.where("state = 'keep'"), entity, fetch, "key").select("key", "ord", "is_local", "score").withColumn("hit", F.lit(1.0))
        if hits is not None:
            own = topk.top_k(self.vectors.join(hits, "key"), self.query_vector(query, EXPERIENCE_TASK), fetch, "key")
            top = top.unionByName(own.select("key", F.lit(0).alias("ord"), F.lit(False).alias("is_local"), "score", "hit"))
        top = top.withColumn("score", topk.boosted(F.col("score"), F.col("hit"), len(patterns))).orderBy(F.desc("score"), "ord", "key").limit(fetch).drop("hit")
        live = candidates.select("key", "name")
        if self.reranker is not None:
            docs = topk.resolved(top.join(self.document_texts(self.records), "key"), self.records, live).where(F.col("text").isNotNull())
            try:
                ranked = rerank(docs.select("key", "name", "text", "score"), query, "text", self.reranker, k)
                rows = ranked.select("key", "name", "score").collect()  # at most k
                ranked = spark.createDataFrame(rows, "key binary, name string, score double")
                out = topk.pad_reranked(ranked, topk.resolved(top, self.records, live).select("key", "name", "score"), k)
                return Answer(self._with_records(out), total, warnings)
            except Exception as e:  # a failing service must not fail the search
                warnings.append(f"reranker failed, falling back to embedding scores: {type(e).__name__}")
        rest = topk.default_tier(found.select("key", "is_local", "ord"), top, k, "key", self.config.default_score, self.config.default_local_score)
        out = topk.final_cut(top, rest.select("key", "is_local", "ord", "score"), k, "key")
        out = topk.resolved(out, self.records, live).select("key", "name", "score")
        return Answer(self._with_records(out), total, warnings)

    def _with_records(self, out: DataFrame) -> DataFrame:
        out = out.join(self.records.select("key", "kind", "interpretation"), "key", "left")
        return out.select("key", "kind", "name", "interpretation", "score").orderBy(F.desc("score"), "key")
