"""Run gates: what a run's parts must agree on, as violation tables (entity, rule) made by joins, and the run's status.

Every check compares long tables by equality; nothing is collected, and a gate
passes when its table is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidex.functions import text as T
from evidex.operators.contracts import Rules, filled, violations

# The stages a run must have passed in each mode, in order.
STAGES = {"distillation": ["evidence", "cards", "profile"], "application": ["evidence", "cards", "profile", "candidate", "evaluation"]}


def _rows(df: DataFrame, entity: str, rule: str) -> DataFrame:
    return df.select(F.col(entity).cast("string").alias("entity"), F.lit(rule).alias("rule"))


def header_violations(runs: DataFrame, run: str = "run_id") -> DataFrame:
    """Rules of a run's header: schema_version, mode, objective, domains, artifacts (a struct with the array manifests)."""
    c = F.col
    rules: Rules = [
        ("schema_version", c("schema_version") == 1),
        ("mode", c("mode").isin(list(STAGES))),
        ("objective", T.is_substantive("objective", 8)),
        ("domains", (F.size("domains") > 0) & filled(c("domains"), 2)),
        ("artifacts", c("artifacts").isNotNull()),
        ("manifests", c("artifacts").isNull() | c("artifacts.manifests").isNotNull()),
    ]
    return violations(runs, run, rules)


def above(path: Column) -> Column:
    """The path and all folders it lies in."""
    parts = F.split(F.regexp_replace(path, "/+$", ""), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def populated(paths: DataFrame, files: DataFrame, path: str = "path") -> DataFrame:
    """Distinct paths that are a file with content, or a folder that holds one at any depth; files: path, length."""
    held = files.where("length > 0").select(F.explode(above(F.col("path"))).alias("_at")).distinct()
    wanted = paths.select(F.col(path), F.regexp_replace(path, "/+$", "").alias("_at")).distinct()
    return wanted.join(held, "_at", "left_semi").select(path)


def candidate_violations(runs: DataFrame, files: DataFrame, run: str = "run_id", candidate: str = "candidate") -> DataFrame:
    """Runs without a registered candidate, and those whose candidate holds nothing."""
    none = _rows(runs.where(F.coalesce(F.trim(candidate), F.lit("")) == ""), run, "candidate_registered")
    there = populated(runs.where(F.trim(candidate) != ""), files, candidate)
    return none.unionAll(_rows(runs.where(F.trim(candidate) != "").join(there, candidate, "left_anti"), run, "candidate_populated"))


def evidence_ready(payload: dict[str, Column]) -> Column:
    """A manifest or an analysis marked ready, with a scope, and items or review tasks."""
    manifest = T.is_substantive(payload["kind"], 3) & F.coalesce(F.size(payload["items"]) > 0, F.lit(False))
    analysis = T.is_substantive(payload["id"], 3) & F.coalesce(F.size(payload["semantic_review_required"]) > 0, F.lit(False))
    return F.coalesce((payload["distillation_status"] == "evidence_ready") & T.is_substantive(payload["status_scope"], 3) & (manifest | analysis), F.lit(False))


def card_bindings(cards: DataFrame, items: DataFrame, files: DataFrame) -> DataFrame:
    """What valid cards and registered items disagree on.

    cards: source_id, path, analysis_artifact, patterns (with evidence); items: id,
    analysis; files: path, length.  Paths are compared as they are.
    """
    own = cards.select("source_id", "path", "analysis_artifact")
    repeated = own.groupBy("source_id").agg(F.count("*").alias("n")).where("n > 1")
    matched = own.join(items.select(F.col("id").alias("source_id"), "analysis").distinct(), "source_id", "left")
    cited = cards.select("source_id", F.col("path").alias("card"), F.explode("patterns").alias("p")).select("source_id", "card", F.explode("p.evidence").alias("e")).select("source_id", "card", F.col("e.artifact").alias("path")).distinct()
    empty = cited.join(populated(cited, files), "path", "left_anti")
    ids, known = own.select("source_id").distinct(), items.select(F.col("id").alias("source_id")).distinct()
    parts = [
        _rows(repeated, "source_id", "card_unique"),
        _rows(matched.where(~F.col("analysis_artifact").eqNullSafe(F.col("analysis"))), "source_id", "analysis_matches"),
        _rows(empty.select("source_id").distinct(), "source_id", "evidence_there"),
        _rows(cited.where("path = card").select("source_id").distinct(), "source_id", "no_self_citation"),
        _rows(known.join(ids, "source_id", "left_anti"), "source_id", "card_missing"),
        _rows(ids.join(known, "source_id", "left_anti"), "source_id", "card_registered"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def profile_sources(profile_ids: DataFrame, card_ids: DataFrame, profile_excluded: DataFrame, card_excluded: DataFrame) -> DataFrame:
    """Sources a profile omits or has beyond the retained cards, and exclusions (source_id, reason) that the two sides don't share."""
    a, b = profile_ids.select("source_id").distinct(), card_ids.select("source_id").distinct()
    left, right = profile_excluded.select("source_id", F.col("reason").alias("x")).distinct(), card_excluded.select("source_id", F.col("reason").alias("y")).distinct()
    differ = left.join(right, "source_id", "full").where(~F.col("x").eqNullSafe(F.col("y"))).select("source_id").distinct()
    return _rows(b.join(a, "source_id", "left_anti"), "source_id", "source_omitted").unionAll(_rows(a.join(b, "source_id", "left_anti"), "source_id", "source_unreviewed")).unionAll(_rows(differ, "source_id", "exclusion_matches"))


def evaluation_bindings(evaluations: DataFrame, runs: DataFrame, run: str = "run_id") -> DataFrame:
    """Evaluations whose profile, objective (but for white space) or candidate is not the run's; a run that isn't there breaks all three."""
    held = evaluations.join(runs.select(run, F.col("profile_id").alias("_p"), F.col("objective").alias("_o"), F.col("candidate").alias("_c")), run, "left")
    c = F.col
    rules: Rules = [("profile_matches", c("profile_id") == c("_p")), ("objective_matches", T.squeezed("objective") == c("_o")), ("candidate_matches", c("candidate") == c("_c"))]
    return violations(held, "evaluation_id", rules)


def merge_refusals(manifests: DataFrame) -> DataFrame:
    """Why manifests can't be merged: fewer than two, one given twice, one not ready, a wrong count.  manifest, distillation_status, source_count, items."""
    n = manifests.select("manifest").distinct().agg(F.count("*").alias("n")).where("n < 2").select(F.lit(None).cast("string").alias("entity"), F.lit("two_manifests").alias("rule"))
    twice = manifests.groupBy("manifest").agg(F.count("*").alias("n")).where("n > 1")
    rules: Rules = [("evidence_ready", F.col("distillation_status") == "evidence_ready"), ("items", F.col("items").isNotNull()), ("source_count", F.col("source_count") == F.size("items"))]
    return n.unionAll(_rows(twice, "manifest", "manifest_once")).unionAll(violations(manifests.dropDuplicates(["manifest"]), "manifest", rules))


def overall(stages: DataFrame, mode: str, run: str = "run_id") -> DataFrame:
    """run and status: complete if every stage of the mode is, else in_progress.  stages: run, stage, status."""
    done = F.count_if((F.col("status") == "complete") & F.col("stage").isin(STAGES[mode]))
    return stages.groupBy(run).agg(F.when(done == len(STAGES[mode]), "complete").otherwise("in_progress").alias("overall_status"))


def report(entities: DataFrame, found: DataFrame, entity: str) -> DataFrame:
    """One row: how many entities were checked, passed and failed, and how many rules were broken."""
    broken = found.groupBy(F.col("entity").alias(entity)).agg(F.count("*").alias("n"))
    each = entities.select(F.col(entity).cast("string").alias(entity)).distinct().join(broken, entity, "left")
    return each.agg(F.count("*").alias("checked"), F.count_if(F.col("n").isNull()).alias("passed"), F.count("n").alias("failed"), F.coalesce(F.sum("n"), F.lit(0)).alias("broken"))


def missing_components(routes: DataFrame, available: DataFrame, route: str = "route", needs: str = "components") -> DataFrame:
    """route, missing (sorted), status: routes whose components aren't all available are partial."""
    lacking = routes.select(route, F.explode(needs).alias("component")).join(available.select("component").distinct(), "component", "left_anti")
    lists = lacking.groupBy(route).agg(F.array_sort(F.collect_set("component")).alias("missing"))
    none = F.array().cast("array<string>")
    return routes.select(route).distinct().join(lists, route, "left").select(route, F.coalesce("missing", none).alias("missing"), F.when(F.col("missing").isNull(), "complete").otherwise("partial").alias("status"))


def annotated(frames: DataFrame, samples: DataFrame, group: list[str], at: str, order: str, fields: list[str]) -> DataFrame:
    """frames with the fields of the sample at the same time to three digits; of several the last by `order`."""
    last = samples.select(*group, F.round(at, 3).alias("_at"), F.struct(order, *fields).alias("_s")).groupBy(*group, "_at").agg(F.max("_s").alias("_s"))
    return frames.withColumn("_at", F.round(at, 3)).join(last, [*group, "_at"], "left").select(*frames.columns, *[F.col(f"_s.{f}").alias(f) for f in fields])


def first_keys(patterns: DataFrame, group: list[str], most: int = 12) -> DataFrame:
    """The first patterns of each group by key, which a generation contract starts from."""
    return patterns.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy("key"))).where(F.col("place") <= most)
