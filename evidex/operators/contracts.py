"""Contracts as tables of violations: (entity, rule) rows; an entity is valid when it has none.

Each validator computes an array of rule names in one narrow pass, then explodes it;
rules that need other rows (duplicates, references) are aggregates and joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidex.functions import text as T

# Identifiers, and what enumerated fields may be.
KEY = "^[a-z0-9][a-z0-9._-]{2,127}$"
SOURCE_TYPES = ["repository", "website", "app", "ui", "image", "brand", "video", "audio", "article", "document", "book", "course", "mixed", "other"]
SCOPES = ["global", "stage", "local", "conditional", "exception"]
EVIDENCE_STATUSES = ["complete", "degraded", "partial"]
ANALYSIS_STATUSES = [*EVIDENCE_STATUSES, "failed", "not_applicable"]

Rules = list[tuple[str, Column]]


def violations(rows: DataFrame, entity: str, rules: Rules) -> DataFrame:
    """entity and rule of every rule that a row breaks; a rule whose condition is null counts as broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules]))
    return rows.select(F.col(entity).alias("entity"), F.explode(broken).alias("rule"))


def every(items: Column, ok) -> Column:
    return F.coalesce(F.forall(items, lambda x: F.coalesce(ok(x), F.lit(False))), F.lit(True))


def filled(items: Column, minimum: int) -> Column:
    return every(items, lambda x: T.is_substantive(x, minimum))


def distinct(items: Column) -> Column:
    return F.coalesce(F.size(F.array_distinct(items)) == F.size(items), F.lit(True))


def located(e: Column) -> Column:
    return T.is_substantive(e["artifact"], 1) & T.is_substantive(e["locator"], 1) & T.is_substantive(e["observation"], 6)


def card_violations(cards: DataFrame) -> DataFrame:
    """Cards of semantic review; an excluded one needs a reason and no patterns, and nothing else is asked of its patterns."""
    c = F.col
    excluded = F.coalesce(c("review_status") == "excluded", F.lit(False))
    p = c("patterns")
    own = lambda ok: excluded | every(p, ok)
    rules: Rules = [
        ("schema_version", c("schema_version") == 1),
        ("source_id", T.is_substantive("source_id", 3)),
        ("source_type", c("source_type").isin(SOURCE_TYPES)),
        ("source_label", T.is_substantive("source_label", 1)),
        ("analysis_artifact", T.is_substantive("analysis_artifact", 1)),
        ("review_status", c("review_status").isin("complete", "excluded")),
        ("summary", T.is_substantive("summary", 12)),
        *[(f, filled(c(f), 2)) for f in ("variables", "exceptions", "limitations")],
        ("exclusion_reason", ~excluded | T.is_substantive("exclusion_reason", 8)),
        ("excluded_patterns", ~excluded | p.isNull() | (F.size(p) == 0)),
        ("patterns", excluded | (p.isNotNull() & (F.size(p) > 0))),
        ("pattern_key", own(lambda x: x["key"].rlike(KEY))),
        ("pattern_key_unique", excluded | distinct(F.transform(p, lambda x: x["key"]))),
        ("pattern_dimension", own(lambda x: T.is_substantive(x["dimension"], 2))),
        ("pattern_statement", own(lambda x: T.is_substantive(x["statement"], 8))),
        ("pattern_mechanism", own(lambda x: T.is_substantive(x["mechanism"], 8))),
        ("pattern_trigger", own(lambda x: T.is_substantive(x["trigger"], 3))),
        ("pattern_boundary", own(lambda x: T.is_substantive(x["boundary"], 3))),
        ("pattern_confidence", own(lambda x: x["confidence"].between(0, 1))),
        ("pattern_scope", own(lambda x: F.coalesce(x["scope"], F.lit("global")).isin(SCOPES))),
        ("pattern_transferable", own(lambda x: x["transferable"].isNotNull())),
        ("pattern_evidence", own(lambda x: F.size(x["evidence"]) > 0)),
        ("evidence_located", own(lambda x: every(x["evidence"], located))),
    ]
    return violations(cards, "source_id", rules)


def profile_violations(profiles: DataFrame, reviewed: bool = True) -> DataFrame:
    """Profiles: header columns and patterns (tier, key, statement, support_count, support_share, mean_confidence, source_ids, evidence, ...)."""
    c, p = F.col, F.col("patterns")
    ids = c("source_ids")
    status = (c("review_status") == "reviewed") if reviewed else c("review_status").isin("draft", "reviewed")
    rules: Rules = [
        ("schema_version", c("schema_version") == 1),
        ("profile_id", T.is_substantive("profile_id", 3)),
        ("domain", T.is_substantive("domain", 2)),
        ("source_count", c("source_count") >= 1),
        ("source_ids", (F.size(ids) > 0) & filled(ids, 3) & distinct(ids)),
        ("source_count_matches", F.coalesce(F.size(ids), F.lit(0)) == c("source_count")),
        ("excluded_sources", every(c("excluded_sources"), lambda x: T.is_substantive(x["source_id"], 3) & T.is_substantive(x["reason"], 8) & ~F.array_contains(ids, x["source_id"]))),
        ("excluded_unique", distinct(F.transform("excluded_sources", lambda x: x["source_id"]))),
        ("review_status", status),
        *([("review_summary", T.is_substantive("review_summary", 12)), ("variants_resolved", every(p, lambda x: F.coalesce(F.size(x["statement_variants"]), F.lit(0)) <= 0))] if reviewed else []),
        ("patterns", F.size(p) > 0),
        ("pattern_key", every(p, lambda x: x["key"].rlike(KEY)) & distinct(F.transform(p, lambda x: x["key"]))),
        ("pattern_statement", every(p, lambda x: T.is_substantive(x["statement"], 8) & T.is_substantive(x["dimension"], 2))),
        ("pattern_sources", every(p, lambda x: (F.size(x["source_ids"]) > 0) & filled(x["source_ids"], 3) & distinct(x["source_ids"]))),
        ("pattern_sources_known", every(p, lambda x: F.size(F.array_except(x["source_ids"], ids)) == 0)),
        ("support_count", every(p, lambda x: (x["support_count"] >= 1) & (x["support_count"] == F.size(F.array_distinct(x["source_ids"]))))),
        ("stable_support", every(p, lambda x: (x["tier"] != "stable") | (x["support_count"] >= 2))),
        ("support_share", every(p, lambda x: (x["support_share"] > 0) & (x["support_share"] <= 1) & (F.abs(x["support_share"] - F.size(F.array_distinct(x["source_ids"])) / F.greatest(F.lit(1), F.size(F.array_distinct(ids)))) <= 0.001))),
        ("mean_confidence", every(p, lambda x: x["mean_confidence"].between(0, 1))),
        *[(f"pattern_{f}", every(p, lambda x, f=f: (F.size(x[f]) > 0) & filled(x[f], 3))) for f in ("mechanisms", "triggers", "boundaries")],
        ("pattern_evidence", every(p, lambda x: (F.size(x["evidence"]) > 0) & every(x["evidence"], lambda e: located(e) & F.array_contains(ids, e["source_id"])))),
        ("evidence_covers_sources", every(p, lambda x: F.size(F.array_except(x["source_ids"], F.transform(x["evidence"], lambda e: e["source_id"]))) == 0)),
        ("contract_mode", c("generation_contract.mode").isin("faithful", "transfer")),
        ("contract_status", (c("generation_contract.review_status") == "reviewed") if reviewed else c("generation_contract.review_status").isin("draft", "reviewed")),
        ("contract_medium", T.is_substantive(c("generation_contract.medium"), 2)),
        ("contract_effect", T.is_substantive(c("generation_contract.target_effect"), 8)),
        *[(f"contract_{f}", (F.size(c(f"generation_contract.{f}")) > 0) & filled(c(f"generation_contract.{f}"), 4)) for f in ("invariants", "variables", "sequence", "negative_constraints", "acceptance")],
    ]
    return violations(profiles, "profile_id", rules)


def evaluation_rollup(evaluations: DataFrame, entity: str = "evaluation_id") -> DataFrame:
    """passed, failed and unresolved (hard constraints that don't pass) of each evaluation."""
    d = F.col("dimensions")
    n = lambda ok: F.size(F.filter(d, lambda x: F.coalesce(ok(x), F.lit(False)))).cast("bigint")
    return evaluations.select(entity, n(lambda x: x["verdict"] == "pass").alias("passed"), n(lambda x: x["verdict"] == "fail").alias("failed"), n(lambda x: x["hard_constraint"] & ~x["verdict"].eqNullSafe("pass")).alias("unresolved"))


def evaluation_violations(evaluations: DataFrame, entity: str = "evaluation_id") -> DataFrame:
    c, d = F.col, F.col("dimensions")
    rows = evaluations.join(evaluation_rollup(evaluations, entity).select(F.col(entity), "passed", "failed", "unresolved"), entity)
    passes, fails = F.coalesce(c("overall_verdict") == "pass", F.lit(False)), F.coalesce(c("overall_verdict") == "fail", F.lit(False))
    some = F.coalesce(F.size("required_revisions") > 0, F.lit(False))
    rules: Rules = [
        ("schema_version", c("schema_version") == 1),
        ("review_status", c("review_status") == "complete"),
        ("candidate", T.is_substantive("candidate", 1)),
        ("profile_id", T.is_substantive("profile_id", 3)),
        ("objective", T.is_substantive("objective", 8)),
        ("evidence_artifacts", (F.size("evidence_artifacts") > 0) & filled(c("evidence_artifacts"), 1) & distinct(c("evidence_artifacts"))),
        ("dimensions", F.size(d) >= 3),
        ("dimension_name", every(d, lambda x: T.is_substantive(x["name"], 2)) & distinct(F.transform(d, lambda x: F.lower(x["name"])))),
        ("dimension_verdict", every(d, lambda x: x["verdict"].isin("pass", "fail", "not_applicable"))),
        ("dimension_evidence", every(d, lambda x: (F.size(x["evidence"]) > 0) & every(x["evidence"], located))),
        ("dimension_notes", every(d, lambda x: T.is_substantive(x["notes"], 4))),
        ("dimension_hard", every(d, lambda x: x["hard_constraint"].isNotNull())),
        ("overall_verdict", c("overall_verdict").isin("pass", "fail")),
        ("pass_without_failures", ~passes | (c("failed") == 0)),
        ("pass_without_unresolved", ~passes | (c("unresolved") == 0)),
        ("pass_needs_three", ~passes | (c("passed") >= 3)),
        ("revisions", c("required_revisions").isNotNull() & filled(c("required_revisions"), 4)),
        ("fail_needs_revisions", ~fails | some),
        ("pass_has_no_revisions", ~passes | ~some),
    ]
    return violations(rows, entity, rules)


def manifest_violations(manifests: DataFrame, analyses: DataFrame) -> DataFrame:
    """Manifests (manifest, header, items) and the analyses their items point to (analysis, id, status, ...), by rule; item rules name the item."""
    c, items = F.col, F.col("items")
    good = F.filter(items, lambda i: ~F.coalesce(i["status"] == "failed", F.lit(False)))
    header: Rules = [
        ("schema_version", c("schema_version") >= 1),
        ("kind", T.is_substantive("kind", 3)),
        ("status_scope", T.is_substantive("status_scope", 3)),
        ("evidence_ready", c("distillation_status") == "evidence_ready"),
        ("source_count", c("source_count") == F.size(items)),
        ("no_failed_items", F.size(good) == F.size(items)),
        ("some_items", F.size(good) > 0),
    ]
    rows = manifests.select("manifest", F.explode(good).alias("i")).select("manifest", "i.*")
    repeated = rows.where("id <> ''").groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias("entity"), F.lit("item_unique").alias("rule"))
    own = analyses.select(F.col("analysis"), F.col("id").alias("_id"), F.col("status").alias("_status"), F.col("distillation_status").alias("_ready"), F.col("status_scope").alias("_scope"), F.col("schema_version").alias("_schema"), F.col("semantic_review_required").alias("_tasks"), F.lit(True).alias("_there"))
    held = rows.join(own, "analysis", "left")
    there = F.coalesce(c("_there"), F.lit(False))
    item: Rules = [
        ("item_id", F.coalesce(F.trim("id"), F.lit("")) != ""),
        ("item_status", c("status").isin(ANALYSIS_STATUSES)),
        ("item_usable", ~c("status").isin(ANALYSIS_STATUSES) | c("status").isin(EVIDENCE_STATUSES)),
        ("item_ready", c("distillation_status") == "evidence_ready"),
        ("item_analysis", T.is_substantive("analysis", 1)),
        ("analysis_there", ~T.is_substantive("analysis", 1) | there),
        ("analysis_schema", ~there | (c("_schema") >= 1)),
        ("analysis_id", ~there | (c("_id") == F.coalesce("analysis_id", "id"))),
        ("analysis_status", ~there | c("_status").eqNullSafe(c("status"))),
        ("analysis_scope", ~there | T.is_substantive("_scope", 3)),
        ("analysis_ready", ~there | (c("_ready") == "evidence_ready")),
        ("analysis_tasks", ~there | (F.size("_tasks") > 0)),
    ]
    return violations(manifests, "manifest", header).unionAll(violations(held, "id", item)).unionAll(repeated)


def run_stages(found: DataFrame) -> DataFrame:
    """stage (in order), violations and status of a run's stages from rows (stage, position, registered, violations); a stage after one that isn't complete is blocked."""
    from pyspark.sql import Window

    w = Window.orderBy("position")
    done = F.col("registered") & (F.col("violations") == 0)
    before = F.coalesce(F.min(done.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(1))
    status = F.when(before == 0, "blocked").when(~F.col("registered"), "missing").when(F.col("violations") > 0, "failed").otherwise("complete")
    return found.select("stage", "position", "violations", status.alias("status"))
