"""Predicates on records and names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semlake.functions import keys, text

# Modules that are never searched, by their last name part.
SKIPPED_MODULES = ("Pure", "Code_Generator", "Code_Evaluation", "Typerep")


def is_skipped(module: Column) -> Column:
    return text.base_name(module).isin(*SKIPPED_MODULES)


def name_contains(name: Column, parts: Sequence[str]) -> Column:
    """All parts, whatever their case (a documented choice of this engine)."""
    out = F.lit(True)
    for p in parts:
        out = out & F.lower(name).contains(p.lower())
    return out


def modules_include(module: Column, parts: Sequence[str]) -> Column:
    """Any part, whatever its case; no parts keep all."""
    out = F.lit(not parts)
    for p in parts:
        out = out | F.lower(module).contains(p.lower())
    return out


def restricted(df: DataFrame, wanted: DataFrame, key: str = "key") -> DataFrame:
    return df.join(wanted.select(key), key, "left_semi")


NO_TOKEN = r"[^A-Za-z0-9_.']+"


def tokens(pattern: Column) -> Column:
    return F.array_distinct(F.filter(F.split(pattern, NO_TOKEN), lambda t: t != ""))


def token_subset(pattern: Column, document: Column) -> Column:
    """All tokens of the pattern occur: a stand-in for structural matching, which needs terms."""
    return F.size(F.array_except(tokens(pattern), tokens(document))) == 0


def hit_rate(patterns: Column, document: Column) -> Column:
    """Share of the patterns (an array) whose tokens all occur. Documents that lack some token of every pattern, even as a part of another,
    are not cut into tokens; others are once, whatever the number of patterns."""
    wanted = F.transform(patterns, tokens)
    # A lambda's variable is computed once; what stands for it is an array of one.
    likely = F.flatten(F.transform(F.array(document), lambda d: F.filter(wanted, lambda p: F.forall(p, lambda t: F.contains(d, t)))))

    def hits(some: Column) -> Column:
        found = F.array(F.array_intersect(F.flatten(some), F.split(document, NO_TOKEN)))
        return F.size(F.flatten(F.transform(found, lambda d: F.filter(some, lambda p: F.size(F.array_except(p, d)) == 0))))

    n = F.transform(F.array(likely), lambda some: F.when(F.size(some) == 0, 0).otherwise(hits(some)))
    return n[0] / F.size(patterns)


def belongs_to(key: Column, kind: Column, constituents: Column, modules: Sequence[bytes]) -> Column:
    """Owned by one of the modules: by a constituent for XOR keys (never if unknown), by prefix for others."""
    wanted = F.array(*[F.lit(m) for m in modules]) if modules else F.array().cast("array<binary>")
    mentions = F.coalesce(F.arrays_overlap(F.transform(constituents, lambda c: c["hash"]), wanted), F.lit(False))
    return F.when(keys.is_xor_keyed(kind), mentions).otherwise(F.array_contains(wanted, keys.prefix(key)))


# Parts of internal names.
INTERNAL_INFIXES = (".class.", "_inst.")
INTERNAL_BASES = ("Abs_", "Rep_")


def is_infra_name(name: Column, concealed: Column, hidden: Column, infra_module: Column, declared: Column, preserved: Column, prefixes: Sequence[str] = (), returns_prop: Column | None = None) -> Column:
    """Internal constants: a declaration decides first, then preservation, then the name."""
    base = text.base_name(name)
    inner = concealed | hidden | infra_module
    for p in prefixes:
        inner = inner | name.startswith(p)
    for p in INTERNAL_INFIXES:
        inner = inner | name.contains(p)
    for p in INTERNAL_BASES:
        inner = inner | base.startswith(p)
    inner = inner | (base.endswith("_class") & (returns_prop if returns_prop is not None else F.lit(False)))
    return declared | (~preserved & inner)


def last_declaration(actions: DataFrame, name: str = "name", seq: str = "seq", action: str = "action") -> DataFrame:
    """Names whose last action is add; del undoes."""
    last = actions.groupBy(name).agg(F.max_by(action, seq).alias("last"))
    return last.where(F.col("last") == "add").select(name)


def mentions_any(facts: DataFrame, consts: str, infra: DataFrame, key: str) -> DataFrame:
    """Keys of the facts that mention an internal constant: exploded and semi-joined, combined before the shuffle."""
    return facts.select(key, F.explode(consts).alias("const")).join(infra.select(F.col("name").alias("const")), "const", "left_semi").select(key).distinct()


def is_infra_fact(name: Column, concealed: Column, hidden: Column, inaccessible: Column, infra_module: Column, declared: Column, mentions: Column, adt: Column, inductive: Column, size: Column) -> Column:
    base = text.base_name(name)
    adt_def = adt & name.endswith("_def")
    inductive_def = inductive & (base.endswith("_def") | (base == "cong"))
    return declared | concealed | hidden | inaccessible | infra_module | adt_def | inductive_def | mentions | (size > 1000)


def is_infra_induction(name: Column, infra_fact: Column) -> Column:
    return infra_fact | name.startswith("Basic_BNFs.")


# Collections of facts that serve tools only, and theories all of whose collections do.
TOOL_COLLECTIONS = (
    "HOL.no_atp", "HOL.atomize_elim",
    "HOL.nitpick_simp", "HOL.nitpick_psimp", "HOL.nitpick_unfold", "HOL.nitpick_choice_spec",
    "HOL.code_pred_def", "HOL.code_pred_inline", "HOL.code_pred_simp",
    "SMT.smt_arith_combine", "SMT.smt_arith_multiplication", "SMT.smt_arith_simplify",
    "Quotient.quot_equiv", "Quotient.quot_preserve", "Quotient.quot_respect",
    "Quotient.quot_thm", "Quotient.id_simps",
    "Lifting.relator_eq_onp",
    "Fun_Def.measure_function", "Fun_Def_Base.termination_simp",
    "Partial_Function.partial_function_mono",
)
TOOL_THEORIES = ("Transfer.", "Lifting.", "SMT.", "Pure.")


def is_infra_collection(name: Column, concealed: Column, hidden: Column, inaccessible: Column) -> Column:
    """Collections of facts nobody would cite: tool-internal ones, congruences up to of codatatypes, names out of reach."""
    base = text.base_name(name)
    inner = name.isin(*TOOL_COLLECTIONS) | base.startswith("cong_") | (base == "coinduct_upto")
    for p in TOOL_THEORIES:
        inner = inner | name.startswith(p)
    return inner | concealed | hidden | inaccessible


def is_infra_scoped(concealed: Column, hidden: Column, infra_module: Column, declared: Column | None = None) -> Column:
    """Types, classes and locales; only types can be declared internal."""
    inner = concealed | hidden | infra_module
    return inner if declared is None else declared | inner


def infra_methods(methods: DataFrame, base: DataFrame, name: str = "name", module: str = "module") -> DataFrame:
    """Names of methods not worth showing: of a module in ``base`` (column module), without a known module, or with a
    true flag among concealed, hidden and inaccessible (null: false)."""
    known = base.select(F.col("module").alias("_base")).distinct()
    flag = F.coalesce(F.col("concealed"), F.lit(False)) | F.coalesce(F.col("hidden"), F.lit(False)) | F.coalesce(F.col("inaccessible"), F.lit(False))
    out = methods.join(known, F.col(module) == F.col("_base"), "left")
    return out.where(F.col(module).isNull() | F.col("_base").isNotNull() | flag).select(name)


def right_length(vector: Column, dimension: int) -> Column:
    """keep, unmigrated (four bytes a component instead of two) or wrong, by the byte length of a stored vector."""
    n = F.octet_length(vector)
    return F.when(n == 2 * dimension, "keep").when(n == 4 * dimension, "unmigrated").otherwise("wrong")


def update_due(auto: Column, last: Column, now: Column, interval_s: int, etag: Column, remote: Column) -> Column:
    due = F.coalesce(F.unix_timestamp(now) - F.unix_timestamp(last) >= interval_s, F.lit(True))
    return auto & due & ~etag.eqNullSafe(remote)


def tool_decision(tool: Column, allowed: Sequence[str]) -> Column:
    """allow or deny with a reason; a call without a name is denied."""
    ok = F.coalesce(tool.isin(*allowed), F.lit(False)) if allowed else F.lit(False)
    reason = F.when(~ok, F.concat(F.lit("tool not allowed: "), F.coalesce(tool, F.lit("(none)"))))
    return F.struct(F.when(ok, "allow").otherwise("deny").alias("decision"), reason.alias("reason"))
