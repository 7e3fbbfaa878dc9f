"""Queries of cards, profiles, evaluations, manifests and inventories, with their SQL.

The tables hold no cards, so they are made from documents and labels: a labelled
document is a source, its languages and sources give pattern keys, quality 0 excludes it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from evidex.operators import contracts, evidence, inventory
from evidex.sources.tables import table


def _cards(spark, d):
    doc = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    c = F.col
    sid = F.concat(F.lit("doc-"), c("doc_id").cast("string"))
    observation = F.when(c("doc_id") % 17 == 0, "n/a").otherwise(F.concat(F.lit("length "), c("n_chars").cast("string")))
    item = F.struct(F.concat(F.lit("analysis/"), sid).alias("artifact"), F.lit("line 1").alias("locator"), observation.alias("observation"))
    key = lambda *x: F.lower(F.concat_ws(".", *x))
    pattern = lambda k, dim: F.struct(
        k.alias("key"), F.lit(dim).alias("dimension"), F.concat(F.lit("Statement   on "), k).alias("statement"), F.lit("because it does so").alias("mechanism"), F.lit("always").alias("trigger"),
        F.when(c("doc_id") % 13 == 0, "-").otherwise("in these texts").alias("boundary"), F.lit("global").alias("scope"), ((c("doc_id") % 5) / 4).alias("confidence"), (c("doc_id") % 7 != 0).alias("transferable"), F.array(item).alias("evidence"),
    )
    made = F.array(pattern(key(c("lang"), F.lit("voice")), "voice"), pattern(key(c("lang"), c("source")), "origin"))
    complete = c("quality") == 1
    return doc.select(
        "doc_id", F.lit(1).alias("schema_version"), sid.alias("source_id"), F.when(c("doc_id") % 19 == 0, "poem").otherwise("document").alias("source_type"), c("source").alias("source_label"),
        F.concat(F.lit("analysis/"), sid).alias("analysis_artifact"), F.when(complete, "complete").otherwise("excluded").alias("review_status"),
        F.when(complete, F.lit(None)).otherwise(F.when(c("doc_id") % 3 == 0, "bad").otherwise("quality too low")).alias("exclusion_reason"), F.concat(F.lit("Summary of "), sid).alias("summary"),
        F.when(complete, made).otherwise(F.slice(made, 1, 0)).alias("patterns"), F.array(F.lit("topic")).alias("variables"), F.array().cast("array<string>").alias("exceptions"), F.array(F.lit("short text")).alias("limitations"),
    )


CARDS = """
doc AS (SELECT d.doc_id, 'doc-' || d.doc_id AS source_id, lang, source, n_chars, quality FROM documents d JOIN labels USING (doc_id)),
pat AS (SELECT source_id, doc_id, k.position, lower(k.key) AS key, (doc_id % 5) / 4.0 AS confidence, doc_id % 7 <> 0 AS transferable, n_chars FROM (SELECT *, unnest([{'position': 0, 'key': lang || '.voice'}, {'position': 1, 'key': lang || '.' || source}]) AS k FROM doc WHERE quality = 1)),
sup AS (SELECT key, count(DISTINCT source_id) AS support_count, round(avg(confidence), 4) AS mean_confidence, 'Statement   on ' || key AS statement, round(count(DISTINCT source_id) / CAST((SELECT greatest(1, count(*)) FROM doc WHERE quality = 1) AS DOUBLE), 4) AS support_share FROM pat WHERE transferable GROUP BY key)
"""


def _support(spark, d):
    cards = _cards(spark, d)
    return evidence.support(evidence.patterns(cards), cards.where("review_status = 'complete'"))


def card_support(spark, d):
    return _support(spark, d)


def pattern_tiers(spark, d):
    return evidence.tiers(_support(spark, d), 2, 0.2).select("key", "tier", "support_count")


def unique_statements(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("statement"))
    return evidence.first_seen(rows, ["conv_id"], "statement", ["turn"]).select("conv_id", "turn", "statement")


def missing_cards(spark, d):
    items = table(spark, d, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("source_id"))
    cards = _cards(spark, d).where("doc_id % 10 <> 0").select("source_id")
    return evidence.missing(items, cards, ["source_id"])


def _cited(spark, d):
    """Support as a profile might claim it: that of the cards, and some made up."""
    p = evidence.patterns(_cards(spark, d)).select("source_id", "key", F.explode("evidence").alias("e"))
    return p.select("source_id", F.when(F.substring("source_id", -1, 1) == "7", F.concat("key", F.lit("x"))).otherwise(F.col("key")).alias("key"), F.col("e.artifact").alias("artifact"), F.when(F.substring("source_id", -1, 1) == "3", "line 2").otherwise(F.col("e.locator")).alias("locator"))


def unbacked_support(spark, d):
    return evidence.unbacked(_cited(spark, d), evidence.patterns(_cards(spark, d)), ["source_id", "key"])


def citation_check(spark, d):
    held = evidence.patterns(_cards(spark, d)).select("source_id", "key", F.explode("evidence").alias("e")).select("source_id", "key", "e.artifact", "e.locator")
    return evidence.unbacked(_cited(spark, d), held, ["source_id", "key", "artifact", "locator"])


def prefix_containment(spark, d):
    cited = table(spark, d, "pages").select(F.regexp_replace("url", "[?#].*$", "").alias("path"))
    roots = table(spark, d, "pages").where("page_id % 9 = 0").select(F.regexp_extract("url", "^https?://[^/]+/[^/?#]*", 0).alias("root"))
    return evidence.outside(cited, roots)


def card_violations(spark, d):
    return contracts.card_violations(_cards(spark, d))


def profile_violations(spark, d):
    """One draft profile a tier of support; ids and evidence as the cards have them."""
    cards = _cards(spark, d)
    rows = evidence.patterns(cards).where("transferable")
    by_key = rows.groupBy("key").agg(F.array_sort(F.collect_set("source_id")).alias("source_ids"), F.array_sort(F.collect_set(F.struct("source_id", F.col("evidence")[0]["artifact"].alias("artifact"), F.col("evidence")[0]["locator"].alias("locator"), F.col("evidence")[0]["observation"].alias("observation")))).alias("evidence"), F.first("dimension").alias("dimension"))
    joined = evidence.tiers(_support(spark, d), 2, 0.2).join(by_key, "key")
    one = lambda x: F.array(F.lit(x))
    p = F.struct("tier", "key", "dimension", "statement", F.array().cast("array<string>").alias("statement_variants"), "support_count", (F.col("support_share") + F.when(F.col("key").endswith("5"), 0.5).otherwise(0.0)).alias("support_share"), "mean_confidence", "source_ids", "evidence", one("because it does so").alias("mechanisms"), one("always").alias("triggers"), one("-").alias("boundaries"))
    ids = cards.where("review_status = 'complete'").agg(F.array_sort(F.collect_set("source_id")).alias("source_ids"), F.count("*").cast("int").alias("source_count"))
    contract = F.struct(F.lit("draft").alias("review_status"), F.lit("faithful").alias("mode"), F.lit("text").alias("medium"), F.lit("reads alike").alias("target_effect"), *[one("keep it so").alias(f) for f in ("invariants", "variables", "sequence", "negative_constraints", "acceptance")])
    profiles = joined.groupBy(F.concat(F.lit("profile-"), F.col("tier")).alias("profile_id")).agg(F.collect_list(p).alias("patterns")).crossJoin(ids).select("*", F.lit(1).alias("schema_version"), F.lit("document").alias("domain"), F.expr("cast(array() as array<struct<source_id:string,reason:string>>)").alias("excluded_sources"), F.lit("draft").alias("review_status"), F.lit("").alias("review_summary"), contract.alias("generation_contract"))
    return contracts.profile_violations(profiles, reviewed=False)


def _evaluations(spark, d):
    c = table(spark, d, "conversations")
    verdict = F.element_at(F.array(*map(F.lit, ["pass", "pass", "pass", "fail", "not_applicable"])), (F.col("conv_id") * 7 + F.col("turn") * 3).cast("int") % 5 + 1)
    e = F.struct(F.lit("candidate.md").alias("artifact"), F.concat(F.lit("turn "), F.col("turn").cast("string")).alias("locator"), F.col("text").alias("observation"))
    odd = lambda k: F.col("conv_id") % k == 0
    name = F.concat(F.lit("dimension "), F.when(odd(11), 0).otherwise(F.col("turn")).cast("string"))
    hard = F.when(odd(13), F.lit(None).cast("boolean")).otherwise(F.col("turn") % 2 == 0)
    dim = F.struct(name.alias("name"), F.when(odd(17), "maybe").otherwise(verdict).alias("verdict"), hard.alias("hard_constraint"), F.when(odd(19), "tbd").otherwise("seen in the turn").alias("notes"), F.when(odd(23), F.slice(F.array(e), 1, 0)).otherwise(F.array(e)).alias("evidence"))
    made = c.groupBy(F.col("conv_id").alias("evaluation_id")).agg(F.array_sort(F.collect_list(dim)).alias("dimensions"))
    passes = F.col("evaluation_id") % 2 == 0
    return made.select("*", F.when(F.col("evaluation_id") % 29 == 0, 2).otherwise(1).alias("schema_version"), F.when(F.col("evaluation_id") % 31 == 0, "draft").otherwise("complete").alias("review_status"), F.lit("candidate.md").alias("candidate"), F.when(F.col("evaluation_id") % 37 == 0, "-").otherwise("profile-a").alias("profile_id"), F.when(F.col("evaluation_id") % 41 == 0, "voice").otherwise("match the voice").alias("objective"), F.when(F.col("evaluation_id") % 43 == 0, F.array(F.lit("a.json"), F.lit("a.json"))).otherwise(F.array(F.lit("a.json"))).alias("evidence_artifacts"), F.when(passes, "pass").otherwise("fail").alias("overall_verdict"), F.when(F.col("evaluation_id") % 3 == 0, F.array(F.lit("shorten it"))).otherwise(F.array().cast("array<string>")).alias("required_revisions"))


def evaluation_verdicts(spark, d):
    return contracts.evaluation_rollup(_evaluations(spark, d))


def evaluation_violations(spark, d):
    return contracts.evaluation_violations(_evaluations(spark, d))


def review_tasks(spark, d):
    kinds = F.array(*map(F.lit, [*evidence.REVIEW_DIMENSIONS, "poem-analysis"]))
    items = table(spark, d, "documents").select("doc_id", F.element_at(kinds, (F.col("doc_id") % 12).cast("int") + 1).alias("kind"))
    return evidence.review_tasks(items)


def evaluation_templates(spark, d):
    media = F.array(*map(F.lit, [*evidence.EVALUATION_DIMENSIONS, *evidence.MEDIUM_ALIASES, "odd"]))
    n = len(evidence.EVALUATION_DIMENSIONS) + len(evidence.MEDIUM_ALIASES) + 1
    return evidence.evaluation_template(table(spark, d, "documents").select("doc_id", F.element_at(media, (F.col("doc_id") % n).cast("int") + 1).alias("medium")))


def manifest_violations(spark, d):
    doc = table(spark, d, "documents")
    c = F.col
    sid = F.concat(F.lit("doc-"), (c("doc_id") - F.when(c("doc_id") % 101 == 100, 1).otherwise(0)).cast("string"))
    status = F.when(c("doc_id") % 29 == 0, "failed").when(c("doc_id") % 31 == 0, "odd").otherwise("complete")
    item = F.struct(sid.alias("id"), status.alias("status"), F.lit("evidence_ready").alias("distillation_status"), F.concat(F.lit("a/"), c("doc_id").cast("string")).alias("analysis"), F.lit(None).cast("string").alias("analysis_id"))
    m = doc.groupBy(F.concat(F.lit("manifest-"), c("lang")).alias("manifest")).agg(F.collect_list(item).alias("items"), F.count("*").alias("source_count")).select("*", F.lit(2).alias("schema_version"), F.lit("document-analysis").alias("kind"), F.lit("extraction").alias("status_scope"), F.lit("evidence_ready").alias("distillation_status"))
    a = doc.where("doc_id % 37 <> 0").select(F.concat(F.lit("a/"), c("doc_id").cast("string")).alias("analysis"), F.concat(F.lit("doc-"), c("doc_id").cast("string")).alias("id"), F.lit("complete").alias("status"), F.lit("evidence_ready").alias("distillation_status"), F.lit("extraction").alias("status_scope"), F.lit(2).alias("schema_version"), F.array(F.lit("voice")).alias("semantic_review_required"))
    return contracts.manifest_violations(m, a)


def path_inventory(spark, d):
    names = F.array(*map(F.lit, ["src/main.py", "tests/test_a.py", "node_modules/x/index.js", ".env", "docs/read.me.HTML", "web/app.tsx", "keys/server.key", "my-secrets.json", "Cargo.toml", "a/b/spec_x.rb", "LICENSE", ".env.test"]))
    files = table(spark, d, "documents").select(F.element_at(names, (F.col("doc_id") % 12).cast("int") + 1).alias("path"), F.col("n_chars").alias("length"))
    return inventory.classified(files).groupBy("path", "skipped", "extension", "language", "top_folder", "is_manifest", "is_entrypoint", "is_test").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def capture_logs(spark, d):
    o = table(spark, d, "conversations").select(F.col("conv_id").alias("log"), F.col("role").alias("action"), F.when(F.col("turn") == 3, " ").otherwise(F.col("text")).alias("observation"), F.concat(F.lit("shot-"), (F.col("conv_id") % 50).cast("string")).alias("artifact"))
    files = table(spark, d, "pages").where("page_id % 4 <> 0").select(F.concat(F.lit("shot-"), F.col("page_id").cast("string")).alias("path"))
    return inventory.capture_summary(o, files)


_paths = [("src/main.py", False, ".py", "Python", "src", False, True, False), ("tests/test_a.py", False, ".py", "Python", "tests", False, False, True), ("node_modules/x/index.js", True, ".js", "JavaScript", "node_modules", False, True, False), (".env", True, "", "Other", ".", False, False, False), ("docs/read.me.HTML", False, ".html", "HTML", "docs", False, False, False), ("web/app.tsx", False, ".tsx", "TypeScript", "web", False, True, False), ("keys/server.key", True, ".key", "Other", "keys", False, False, False), ("my-secrets.json", True, ".json", "Other", ".", False, False, False), ("Cargo.toml", False, ".toml", "Other", ".", True, False, False), ("a/b/spec_x.rb", False, ".rb", "Ruby", "a", False, False, True), ("LICENSE", False, "", "Other", ".", False, False, False), (".env.test", True, ".test", "Other", ".", False, False, False)]
_values = ", ".join(f"({k}, '{p[0]}', {p[1]}, '{p[2]}', '{p[3]}', '{p[4]}', {p[5]}, {p[6]}, {p[7]})" for k, p in enumerate(_paths))
_kinds = ", ".join(f"({k}, '{kind}', {pos}, '{dim}')" for k, kind in enumerate([*evidence.REVIEW_DIMENSIONS, "poem-analysis"]) for pos, dim in enumerate(evidence.REVIEW_DIMENSIONS.get(kind, evidence.REVIEW_DIMENSIONS["mixed-analysis"])))
_media = [*evidence.EVALUATION_DIMENSIONS, *evidence.MEDIUM_ALIASES, "odd"]
_templates = ", ".join(f"({k}, '{m}', {pos}, '{name}', {hard})" for k, m in enumerate(_media) for pos, (name, hard) in enumerate(evidence.EVALUATION_DIMENSIONS.get(evidence.MEDIUM_ALIASES.get(m, m), evidence.EVALUATION_DIMENSIONS["mixed"])))
EVAL = """e AS (SELECT conv_id AS evaluation_id, turn, text, CASE WHEN conv_id % 17 = 0 THEN 'maybe' ELSE ['pass', 'pass', 'pass', 'fail', 'not_applicable'][CAST((conv_id * 7 + turn * 3) % 5 + 1 AS INTEGER)] END AS v FROM conversations),
r AS (SELECT evaluation_id, count(*) AS n, count(*) FILTER (v = 'pass') AS passed, count(*) FILTER (v = 'fail') AS failed, count(*) FILTER (evaluation_id % 13 <> 0 AND turn % 2 = 0 AND v <> 'pass') AS unresolved FROM e GROUP BY evaluation_id)"""

QUERIES = {
    "card_support": (card_support, f"WITH {CARDS} SELECT key, support_count, mean_confidence, statement, support_share FROM sup"),
    "pattern_tiers": (pattern_tiers, f"WITH {CARDS} SELECT key, CASE WHEN support_count >= 2 AND support_share >= 0.2 THEN 'stable' WHEN support_count >= 2 THEN 'conditional' ELSE 'observation' END AS tier, support_count FROM sup"),
    "unique_statements": (unique_statements, r"WITH s AS (SELECT conv_id, turn, trim(regexp_replace(text, '[ \t\n\r\f\x0b]+', ' ', 'g')) AS statement FROM conversations) SELECT conv_id, turn, statement FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, lower(statement) ORDER BY turn) AS r FROM s WHERE statement <> '') WHERE r = 1"),
    "missing_cards": (missing_cards, f"WITH {CARDS} SELECT 'doc-' || doc_id AS source_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM doc WHERE doc_id % 10 <> 0)"),
    "unbacked_support": (unbacked_support, f"WITH {CARDS} SELECT DISTINCT source_id, key || 'x' AS key FROM pat WHERE right(source_id, 1) = '7'"),
    "citation_check": (citation_check, f"WITH {CARDS} SELECT DISTINCT source_id, CASE WHEN right(source_id, 1) = '7' THEN key || 'x' ELSE key END AS key, 'analysis/' || source_id AS artifact, CASE WHEN right(source_id, 1) = '3' THEN 'line 2' ELSE 'line 1' END AS locator FROM pat WHERE right(source_id, 1) IN ('7', '3')"),
    "prefix_containment": (prefix_containment, "WITH c AS (SELECT DISTINCT regexp_replace(url, '[?#].*$', '') AS path FROM pages), r AS (SELECT DISTINCT regexp_replace(regexp_extract(url, '^https?://[^/]+/[^/?#]*', 0), '/+$', '') AS root FROM pages WHERE page_id % 9 = 0) SELECT path FROM c WHERE NOT EXISTS (SELECT 1 FROM r WHERE rtrim(path, '/') = root OR starts_with(path, root || '/'))"),
    "card_violations": (card_violations, f"WITH {CARDS} SELECT source_id AS entity, 'source_type' AS rule FROM doc WHERE doc_id % 19 = 0 UNION ALL SELECT source_id, 'exclusion_reason' FROM doc WHERE quality = 0 AND doc_id % 3 = 0 UNION ALL SELECT source_id, 'pattern_boundary' FROM doc WHERE quality = 1 AND doc_id % 13 = 0 UNION ALL SELECT source_id, 'evidence_located' FROM doc WHERE quality = 1 AND doc_id % 17 = 0"),
    "profile_violations": (profile_violations, f"WITH {CARDS}, t AS (SELECT *, 'profile-' || CASE WHEN support_count >= 2 AND support_share >= 0.2 THEN 'stable' WHEN support_count >= 2 THEN 'conditional' ELSE 'observation' END AS entity FROM sup) SELECT DISTINCT entity, 'pattern_boundaries' AS rule FROM t UNION ALL SELECT DISTINCT entity, 'support_share' FROM t WHERE key LIKE '%5' UNION ALL SELECT DISTINCT t.entity, 'pattern_evidence' FROM t JOIN pat USING (key) WHERE transferable AND doc_id % 17 = 0"),
    "evaluation_verdicts": (evaluation_verdicts, f"WITH {EVAL} SELECT evaluation_id, passed, failed, unresolved FROM r"),
    "evaluation_violations": (evaluation_violations, f"WITH {EVAL}, x AS (SELECT *, evaluation_id % 2 = 0 AS p, evaluation_id % 3 = 0 AS has FROM r) SELECT evaluation_id AS entity, 'dimensions' AS rule FROM x WHERE n < 3 UNION ALL SELECT evaluation_id, 'pass_without_failures' FROM x WHERE p AND failed > 0 UNION ALL SELECT evaluation_id, 'pass_without_unresolved' FROM x WHERE p AND unresolved > 0 UNION ALL SELECT evaluation_id, 'pass_needs_three' FROM x WHERE p AND passed < 3 UNION ALL SELECT evaluation_id, 'fail_needs_revisions' FROM x WHERE NOT p AND NOT has UNION ALL SELECT evaluation_id, 'pass_has_no_revisions' FROM x WHERE p AND has UNION ALL SELECT evaluation_id, 'dimension_name' FROM x WHERE evaluation_id % 11 = 0 AND n > 1 UNION ALL SELECT evaluation_id, 'dimension_hard' FROM x WHERE evaluation_id % 13 = 0 UNION ALL SELECT evaluation_id, 'dimension_verdict' FROM x WHERE evaluation_id % 17 = 0 UNION ALL SELECT evaluation_id, 'dimension_notes' FROM x WHERE evaluation_id % 19 = 0 UNION ALL SELECT DISTINCT evaluation_id, 'dimension_evidence' FROM e WHERE evaluation_id % 23 = 0 OR length(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\x0b]+', ' ', 'g'))) < 6 UNION ALL SELECT evaluation_id, 'schema_version' FROM x WHERE evaluation_id % 29 = 0 UNION ALL SELECT evaluation_id, 'review_status' FROM x WHERE evaluation_id % 31 = 0 UNION ALL SELECT evaluation_id, 'profile_id' FROM x WHERE evaluation_id % 37 = 0 UNION ALL SELECT evaluation_id, 'objective' FROM x WHERE evaluation_id % 41 = 0 UNION ALL SELECT evaluation_id, 'evidence_artifacts' FROM x WHERE evaluation_id % 43 = 0"),
    "evaluation_templates": (evaluation_templates, f"WITH m(k, medium, position, name, hard_constraint) AS (VALUES {_templates}) SELECT doc_id, medium, CAST(position AS INTEGER) AS position, name, hard_constraint FROM documents JOIN m ON k = doc_id % {len(_media)}"),
    "review_tasks": (review_tasks, f"WITH k(k, kind, position, dimension) AS (VALUES {_kinds}) SELECT doc_id, kind, CAST(position AS INTEGER) AS position, dimension FROM documents JOIN k ON k.k = doc_id % 12"),
    "manifest_violations": (manifest_violations, "WITH i AS (SELECT doc_id, 'manifest-' || lang AS m, 'doc-' || CASE WHEN doc_id % 101 = 100 THEN doc_id - 1 ELSE doc_id END AS id, CASE WHEN doc_id % 29 = 0 THEN 'failed' WHEN doc_id % 31 = 0 THEN 'odd' ELSE 'complete' END AS s FROM documents), g AS (SELECT * FROM i WHERE s <> 'failed') SELECT DISTINCT m AS entity, 'no_failed_items' AS rule FROM i WHERE s = 'failed' UNION ALL SELECT id, 'item_status' FROM g WHERE s = 'odd' UNION ALL SELECT id, 'analysis_there' FROM g WHERE doc_id % 37 = 0 UNION ALL SELECT id, 'analysis_status' FROM g WHERE doc_id % 37 <> 0 AND s = 'odd' UNION ALL SELECT id, 'analysis_id' FROM g WHERE doc_id % 37 <> 0 AND doc_id % 101 = 100 UNION ALL SELECT id, 'item_unique' FROM g GROUP BY id HAVING count(*) > 1"),
    "path_inventory": (path_inventory, f"WITH p(k, path, skipped, extension, language, top_folder, is_manifest, is_entrypoint, is_test) AS (VALUES {_values}) SELECT p.* EXCLUDE (k), count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS bytes FROM documents JOIN p ON k = doc_id % 12 GROUP BY ALL"),
    "capture_logs": (capture_logs, "WITH o AS (SELECT conv_id AS log, turn, 'shot-' || (conv_id % 50) AS artifact FROM conversations), s AS (SELECT log, count(*) AS declared, count(*) FILTER (turn <> 3 AND artifact IN (SELECT 'shot-' || page_id FROM pages WHERE page_id % 4 <> 0)) AS valid FROM o GROUP BY log) SELECT log, declared, valid, CASE WHEN valid > 0 AND valid = declared THEN 'available' WHEN valid > 0 THEN 'partial' ELSE 'invalid' END AS status FROM s"),
}
