"""Catalogue: texts, names and classifications."""

from __future__ import annotations

from pyspark.sql import functions as F

from semlake.functions import text
from semlake.operators import filters, joins, report
from semlake.plans.vectors import table
from semlake.sources import entities

QUERY_TEMPLATE = "Instruct: {task}\nQuery: {text}"
TASK = "Given a question, retrieve relevant {kinds}"


def document_text(spark, sf_dir):
    """Documents as records: doc_id % 4 = 0 are experiences whose patterns are their source and language; % 5 = 0 have no interpretation."""
    df = table(spark, sf_dir, "documents")
    kind = F.when(F.col("doc_id") % 4 == 0, 8).otherwise(1)
    interpretation = F.when(F.col("doc_id") % 5 != 0, F.col("text"))
    patterns = F.when(F.col("doc_id") % 8 != 0, F.array("source", "lang"))
    expr = F.when(F.col("doc_id") % 3 == 0, text.truncate(F.col("text"))).otherwise(F.lit(""))
    out = text.document_text(kind, F.lit("constant"), F.col("source"), expr, interpretation, patterns)
    return df.select("doc_id", out.alias("document_text"))


def prompt_template(spark, sf_dir):
    task = text.template_task(TASK, text.render_kinds([1, 2, 0x12, 0x22]))
    df = table(spark, sf_dir, "benchmark")
    return df.select("item_id", text.apply_template(F.col("text"), QUERY_TEMPLATE, "query", task).alias("prompt"), text.apply_template(F.col("text"), "{text}", "document").alias("plain"))


def kinds_phrases(spark, sf_dir):
    """Phrases of the languages of each source, as kinds are joined."""
    df = table(spark, sf_dir, "documents").groupBy("source").agg(F.sort_array(F.collect_set("lang")).alias("langs"))
    return df.select("source", text.render_kinds_column(F.col("langs")).alias("phrase"))


def endpoint_domain(spark, sf_dir):
    df = table(spark, sf_dir, "pages")
    url = F.concat("url", F.lit("?key=secret"))
    return df.select("page_id", text.endpoint_domain(url).alias("domain"), text.redact_url(url).alias("shown"), text.has_version_segment(url).alias("versioned"))


def http_hints(spark, sf_dir):
    df = table(spark, sf_dir, "pages")
    status = F.element_at(F.array(*map(F.lit, (200, 400, 401, 404, 429, 500))), (F.col("page_id") % 6 + 1).cast("int"))
    hint = text.http_hint(status, status == 401, F.col("page_id") % 4 != 2, F.col("url"))
    return df.select("page_id", status.alias("status"), hint.alias("hint"))


def rule_name_kind(spark, sf_dir):
    """Part names as dotted names with rule endings and indices."""
    df = table(spark, sf_dir, "part")
    ending = F.element_at(F.array(*map(F.lit, ("I", "E", "_induct", "_cases", "_intro", ".dest", "XI", "(3)", ""))), (F.col("p_partkey") % 9 + 1).cast("int"))
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit(".")), ending)
    fact = text.fact_name(name)
    return df.select("p_partkey", text.rule_kind(name).alias("rule_kind"), fact["name"].alias("fact"), fact["index"].alias("index"), text.base_name(name).alias("base"))


def error_classes(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    pick = lambda c, n, *x: F.element_at(F.array(*[F.lit(v) for v in x]), (c % n + 1).cast("int"))
    error = F.when(F.col("event_id") % 3 == 0, pick(F.col("event_id"), 5, "rate_limit", "server_error", "authentication_failed", "billing_error", "unknown"))
    status = F.when(F.col("event_id") % 4 == 0, pick(F.col("event_id"), 3, 400, 401, 500))
    result = F.when(F.col("event_id") % 7 == 0, pick(F.col("event_id"), 3, "You've hit your limit today", "Rate limit reached", "Not logged in"))
    return df.groupBy(text.error_class(error, status, result).alias("class")).agg(F.count("*").alias("n"))


def infra_filter(spark, sf_dir):
    """Internal names: toxic labels are declarations, later ones with quality 0 undo; the source is the module."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    actions = labels.select(F.col("doc_id").alias("name"), F.col("doc_id").alias("seq"), F.when((F.col("toxic") == 1) & (F.col("quality") == 1), "add").otherwise("del").alias("action"))
    declared = filters.last_declaration(actions).select(F.col("name").alias("doc_id"), F.lit(True).alias("declared"))
    df = docs.join(declared, "doc_id", "left")
    name = F.concat(F.col("source"), F.lit("."), F.when(F.col("doc_id") % 11 == 0, "Abs_x").when(F.col("doc_id") % 13 == 0, "a.class.b").otherwise("plain"))
    infra = filters.is_infra_name(name, F.lit(False), F.col("n_chars") < 100, F.col("source") == "src3", F.coalesce("declared", F.lit(False)), F.col("lang") == "de")
    return df.groupBy("source").agg(F.count_if(infra).alias("infra"), F.count_if(~infra).alias("visible"))


def name_filters(spark, sf_dir):
    """Name and module substrings, whatever their case, and the fixed list of skipped modules."""
    df = table(spark, sf_dir, "part")
    module = F.concat(F.lit("M."), F.element_at(F.split("p_name", " "), 1))
    keep = filters.name_contains(F.col("p_name"), ["A", "e"]) & filters.modules_include(module, ["R", "bl"]) & ~filters.is_skipped(module)
    return df.where(keep).select("p_partkey", "p_name")


def token_match(spark, sf_dir):
    """Share of three patterns whose tokens all occur; only matches are kept."""
    df = table(spark, sf_dir, "documents")
    patterns = F.array(F.lit("the and"), F.lit("la le"), F.lit("zzz"))
    rate = filters.hit_rate(patterns, F.lower("text"))
    hit = F.filter(F.array(F.round(rate, 6)), lambda x: x > 0)  # not a filter below, which would compute the rate again
    return df.select("doc_id", F.explode(hit).alias("hit_rate"))


def ident_prefix_resolve(spark, sf_dir):
    """Identifiers are names or hex prefixes of the md5 of a source; some are ambiguous."""
    names = table(spark, sf_dir, "documents").select(F.col("source").alias("name")).distinct().withColumn("hash", F.unhex(F.md5("name")))
    idents = names.select(F.col("name").alias("ident")).unionByName(names.select(F.substring(F.md5("name"), 1, 1).alias("ident"))).unionByName(names.select(F.substring(F.md5("name"), 1, 9).alias("ident"))).distinct()
    out = joins.resolve_identifiers(idents, names)
    return out.select("ident", F.lower(F.hex("hash")).alias("hash"), "state")


def token_percentiles(spark, sf_dir):
    return report.percentiles(table(spark, sf_dir, "documents"), "n_chars").select("p25", "p50", "p75", "max", F.col("total").cast("bigint").alias("total"), "over_1000", "over_2000", "over_3000")


def to_embed(spark, sf_dir):
    df = table(spark, sf_dir, "documents").withColumn("t", F.when(F.col("doc_id") % 3 != 0, F.col("text")))
    return report.to_embed(df, "t").select(F.col("chars").cast("bigint").alias("chars"), "renderable", "unrenderable")


def word_offsets(spark, sf_dir):
    """First place of some words in each benchmark text."""
    src = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("source"), F.concat(F.lit("lemma the: "), "text").alias("content"))
    names = src.select("source", F.explode(F.array(F.lit("the"), F.lit("A.of(2)"), F.lit("la"), F.lit("nowhere"))).alias("name"))
    out = entities.name_offsets(src, names)
    return out.select("source", "name", F.col("word_off").cast("bigint").alias("word_off"), F.col("goal_off").cast("bigint").alias("goal_off"))


_DOMAIN = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)"
_NAME = "replace(p_name, ' ', '.') || ['I', 'E', '_induct', '_cases', '_intro', '.dest', 'XI', '(3)', ''][CAST(p_partkey % 9 + 1 AS INTEGER)]"
ORACLES = {
    "document_text": """SELECT doc_id, CASE WHEN i IS NULL THEN NULL WHEN k = 8 THEN CASE WHEN doc_id % 8 <> 0 THEN
  'This is an experience that aims to help prove goals of the following forms:' || chr(10) || '- ' || source || chr(10) || '- ' || lang || chr(10) || 'The experience should be used in the following situation:' || chr(10) || i END
  ELSE 'constant ' || source || CASE WHEN e <> '' THEN ': ' || e ELSE '' END || chr(10) || i END AS document_text
FROM (SELECT *, CASE WHEN doc_id % 4 = 0 THEN 8 ELSE 1 END AS k, CASE WHEN doc_id % 5 <> 0 THEN text END AS i,
  CASE WHEN doc_id % 3 = 0 THEN CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '…' ELSE text END ELSE '' END AS e FROM documents)""",
    "prompt_template": "SELECT item_id, 'Instruct: Given a question, retrieve relevant constants, theorems and inference rules' || chr(10) || 'Query: ' || text AS prompt, text AS plain FROM benchmark",
    "kinds_phrases": "SELECT source, CASE WHEN len(l) = 1 THEN l[1] ELSE array_to_string(l[:len(l) - 1], ', ') || ' and ' || l[len(l)] END AS phrase FROM (SELECT source, list_sort(list(DISTINCT lang)) AS l FROM documents GROUP BY source)",
    "endpoint_domain": f"""SELECT page_id, lower({_DOMAIN}) || CASE WHEN p = '' OR (s = 'https' AND p = '443') OR (s = 'http' AND p = '80') THEN '' ELSE ':' || p END AS domain,
  regexp_replace(url, '[?#].*$', '') AS shown, regexp_matches(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '(^|/)v[0-9]') AS versioned
FROM (SELECT page_id, url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS s, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?[^/?#:]*:([0-9]+)', 1) AS p FROM pages)""",
    "http_hints": """SELECT page_id, status, CASE WHEN status = 401 AND page_id % 4 = 2 THEN 'no_key' WHEN status = 401 THEN 'rejected_key'
  WHEN status = 404 AND NOT regexp_matches(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '(^|/)v[0-9]') THEN 'check_model_and_version'
  WHEN status IN (400, 404, 422) THEN 'check_model' WHEN status = 429 THEN 'rate_or_quota' ELSE '' END AS hint
FROM (SELECT page_id, url, [200, 400, 401, 404, 429, 500][CAST(page_id % 6 + 1 AS INTEGER)] AS status FROM pages)""",
    "rule_name_kind": f"""SELECT p_partkey, CASE WHEN regexp_matches(b, '[^A-Z]I$') OR regexp_matches(n, '[_.]intros?$') THEN 'introduction'
  WHEN regexp_matches(b, '[^A-Z]E$') OR regexp_matches(n, '[_.](elim|elims|dest)$') THEN 'elimination' WHEN regexp_matches(b, '(_induct|_ind)$') THEN 'induction'
  WHEN regexp_matches(b, '(_cases|_case)$') THEN 'case_split' ELSE 'none' END AS rule_kind,
  CASE WHEN regexp_matches(n, '^.*\\([0-9]+\\)$') THEN regexp_extract(n, '^(.*)\\(([0-9]+)\\)$', 1) ELSE n END AS fact,
  CASE WHEN regexp_matches(n, '^.*\\([0-9]+\\)$') THEN CAST(regexp_extract(n, '^(.*)\\(([0-9]+)\\)$', 2) AS INTEGER) END AS index, b AS base
FROM (SELECT p_partkey, n, string_split(n, '.')[-1] AS b FROM (SELECT p_partkey, {_NAME} AS n FROM part))""",
    "error_classes": """SELECT class, count(*) AS n FROM (SELECT CASE WHEN e = 'rate_limit' THEN 'rate_limit' WHEN e = 'server_error' THEN 'transient' WHEN e = 'authentication_failed' THEN 'auth'
  WHEN e = 'billing_error' THEN 'billing' WHEN starts_with(r, 'You''ve hit your limit') THEN 'limit' WHEN contains(r, 'Rate limit') THEN 'rate_limit' WHEN s = 400 THEN 'poisoned'
  WHEN contains(lower(r), 'not logged in') OR s = 401 THEN 'auth' WHEN e IS NOT NULL OR s >= 400 THEN 'fatal' ELSE 'ok' END AS class
FROM (SELECT CASE WHEN event_id % 3 = 0 THEN ['rate_limit', 'server_error', 'authentication_failed', 'billing_error', 'unknown'][CAST(event_id % 5 + 1 AS INTEGER)] END AS e,
  CASE WHEN event_id % 4 = 0 THEN [400, 401, 500][CAST(event_id % 3 + 1 AS INTEGER)] END AS s,
  coalesce(CASE WHEN event_id % 7 = 0 THEN ['You''ve hit your limit today', 'Rate limit reached', 'Not logged in'][CAST(event_id % 3 + 1 AS INTEGER)] END, '') AS r FROM events)) GROUP BY class""",
    "infra_filter": """SELECT source, count(*) FILTER (WHERE infra) AS infra, count(*) FILTER (WHERE NOT infra) AS visible FROM (
  SELECT source, d.doc_id IS NOT NULL OR (lang <> 'de' AND (n_chars < 100 OR source = 'src3' OR x.doc_id % 11 = 0 OR x.doc_id % 13 = 0)) AS infra
  FROM documents x LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1 AND quality = 1) d ON d.doc_id = x.doc_id) GROUP BY source""",
    "name_filters": """SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'a') AND contains(lower(p_name), 'e')
  AND (contains(lower('M.' || string_split(p_name, ' ')[1]), 'r') OR contains(lower('M.' || string_split(p_name, ' ')[1]), 'bl'))
  AND string_split('M.' || string_split(p_name, ' ')[1], '.')[-1] NOT IN ('Pure', 'Code_Generator', 'Code_Evaluation', 'Typerep')""",
    "token_match": """SELECT doc_id, round(((list_contains(t, 'the') AND list_contains(t, 'and'))::INT + (list_contains(t, 'la') AND list_contains(t, 'le'))::INT + list_contains(t, 'zzz')::INT) / 3, 6) AS hit_rate
FROM (SELECT doc_id, regexp_split_to_array(lower(text), '[^A-Za-z0-9_.'']+') AS t FROM documents) WHERE hit_rate > 0""",
    "ident_prefix_resolve": """WITH n AS (SELECT DISTINCT source AS name, md5(source) AS h FROM documents),
i AS (SELECT name AS ident FROM n UNION SELECT substr(h, 1, 1) FROM n UNION SELECT substr(h, 1, 9) FROM n),
m AS (SELECT ident, h FROM i JOIN n ON ident = name UNION SELECT ident, h FROM i JOIN n ON starts_with(h, ident) WHERE ident NOT IN (SELECT name FROM n)),
c AS (SELECT ident, count(DISTINCT h) AS k, min(h) AS h FROM m GROUP BY ident)
SELECT i.ident, CASE WHEN k = 1 THEN h END AS hash, CASE WHEN k IS NULL THEN 'none' WHEN k > 1 THEN 'ambiguous' ELSE 'found' END AS state FROM i LEFT JOIN c ON i.ident = c.ident""",
    "token_percentiles": """SELECT quantile_cont(n_chars, 0.25) AS p25, quantile_cont(n_chars, 0.5) AS p50, quantile_cont(n_chars, 0.75) AS p75, max(n_chars) AS max, CAST(sum(n_chars) AS BIGINT) AS total,
  count(*) FILTER (WHERE n_chars > 1000) AS over_1000, count(*) FILTER (WHERE n_chars > 2000) AS over_2000, count(*) FILTER (WHERE n_chars > 3000) AS over_3000 FROM documents""",
    "to_embed": "SELECT CAST(sum(length(text)) FILTER (WHERE doc_id % 3 <> 0) AS BIGINT) AS chars, count(*) FILTER (WHERE doc_id % 3 <> 0) AS renderable, count(*) FILTER (WHERE doc_id % 3 = 0) AS unrenderable FROM documents",
}

QUERIES = {name: globals()[name] for name in (*ORACLES, "word_offsets")}
