import copy

import pytest

from evidex.operators import contracts, evidence, inventory
from pyspark.sql import functions as F

EVIDENCE = "array<struct<artifact:string,locator:string,observation:string>>"
CARD = f"schema_version int, source_id string, source_type string, source_label string, analysis_artifact string, review_status string, exclusion_reason string, summary string, patterns array<struct<key:string,dimension:string,statement:string,mechanism:string,trigger:string,boundary:string,scope:string,confidence:double,transferable:boolean,evidence:{EVIDENCE}>>, variables array<string>, exceptions array<string>, limitations array<string>"
EVALUATION = f"evaluation_id string, schema_version int, review_status string, profile_id string, objective string, candidate string, evidence_artifacts array<string>, dimensions array<struct<name:string,hard_constraint:boolean,verdict:string,evidence:{EVIDENCE},notes:string>>, overall_verdict string, required_revisions array<string>"


def pattern(key="voice.calm"):
    return {"key": key, "dimension": "voice", "statement": "Sentences stay calm", "mechanism": "short clauses", "trigger": "always", "boundary": "not in titles", "scope": "global", "confidence": 0.8, "transferable": True, "evidence": [{"artifact": "a.json", "locator": "line 3", "observation": "calm sentence"}]}


def card(source="source-a", **other):
    return {"schema_version": 1, "source_id": source, "source_type": "document", "source_label": "A", "analysis_artifact": "a.json", "review_status": "complete", "exclusion_reason": None, "summary": "A calm and even text", "patterns": [pattern()], "variables": ["topic"], "exceptions": [], "limitations": ["one text"]} | other


def rules(spark, rows, schema, validate):
    return {r.rule for r in validate(spark.createDataFrame(rows, schema)).collect()}


def test_cards(spark):
    check = lambda *c: rules(spark, list(c), CARD, contracts.card_violations)
    assert check(card()) == set()
    assert {"summary", "patterns"} <= check(card(summary="", patterns=[]))
    assert check(card(review_status="excluded", exclusion_reason="a broken scan", patterns=[])) == set()
    assert check(card(review_status="excluded", exclusion_reason="bad")) == {"exclusion_reason", "excluded_patterns"}
    two = pattern() | {"key": "Bad Key", "confidence": 1.5, "scope": "odd", "evidence": []}
    assert {"pattern_key", "pattern_confidence", "pattern_scope", "pattern_evidence"} == check(card(patterns=[pattern(), two]))
    assert "pattern_key_unique" in check(card(patterns=[pattern(), pattern()]))
    assert {"source_type", "review_status", "patterns"} <= check(card(source_type=None, review_status=None, patterns=None))


def test_singleton_stays_an_observation(spark):
    rows = [card("source-a", patterns=[pattern(), pattern("only.here")]), card("source-b"), card("source-c", review_status="excluded", exclusion_reason="a broken scan", patterns=[])]
    cards = spark.createDataFrame(rows, CARD)
    found = evidence.tiers(evidence.support(evidence.patterns(cards), cards.where("review_status = 'complete'")))
    assert {r.key: (r.support_count, r.tier) for r in found.collect()} == {"voice.calm": (2, "stable"), "only.here": (1, "observation")}


def test_fabricated_support_is_found(spark):
    cards = spark.createDataFrame([card("source-a"), card("source-b")], CARD)
    cited = spark.createDataFrame([("source-a", "voice.calm"), ("source-b", "made.up")], "source_id string, key string")
    assert [tuple(r) for r in evidence.unbacked(cited, evidence.patterns(cards), ["source_id", "key"]).collect()] == [("source-b", "made.up")]


def evaluation(**other):
    e = [{"artifact": "b.json", "locator": "line 1", "observation": "seen there"}]
    d = [{"name": f"dimension {k}", "hard_constraint": k == 0, "verdict": "pass", "evidence": e, "notes": "as asked"} for k in range(3)]
    return {"evaluation_id": "e", "schema_version": 1, "review_status": "complete", "profile_id": "profile", "objective": "match the voice", "candidate": "c.md", "evidence_artifacts": ["b.json"], "dimensions": d, "overall_verdict": "pass", "required_revisions": []} | other


def test_evaluations(spark):
    check = lambda **x: rules(spark, [evaluation(**x)], EVALUATION, contracts.evaluation_violations)
    assert check() == set()
    assert check(evidence_artifacts=[]) == {"evidence_artifacts"}
    d = copy.deepcopy(evaluation()["dimensions"])
    d[0]["verdict"], d[1]["evidence"] = "not_applicable", []
    assert check(dimensions=d) == {"pass_without_unresolved", "pass_needs_three", "dimension_evidence"}
    assert check(overall_verdict="fail") == {"fail_needs_revisions"}
    assert check(required_revisions=["shorten it"]) == {"pass_has_no_revisions"}


def test_run_stages(spark):
    rows = [("manifests", 0, True, 0), ("cards", 1, True, 2), ("profile", 2, True, 0), ("candidate", 3, False, 0)]
    got = contracts.run_stages(spark.createDataFrame(rows, "stage string, position int, registered boolean, violations int")).orderBy("position").collect()
    assert [r.status for r in got] == ["complete", "failed", "blocked", "blocked"]


def test_inventory(spark):
    files = spark.createDataFrame([("main.py", 3), (".env", 1), ("client-secret.key", 1), ("a/Test_x.py", 2), ("tests/b.go", 9)], "path string, length long")
    got = {r.path: r for r in inventory.classified(files).collect()}
    assert [p for p in got if got[p].skipped] == [".env", "client-secret.key"]
    assert got["main.py"].is_entrypoint and got["a/Test_x.py"].is_test and got["tests/b.go"].is_test and got["tests/b.go"].language == "Go"
    text = spark.createDataFrame([("a>=1\n# c\n-r x\nb[c]\n\na==2", '{"dependencies": {"x": "1"}, "devDependencies": {"a": "2", "x": "1"}}', "module m\nrequire (\n\tgithub.com/a/b v1.2.3\n)")], "r string, p string, g string")
    r = text.select(inventory.requirements(F.col("r")), inventory.package_json(F.col("p")), inventory.go_mod(F.col("g"))).first()
    assert tuple(r) == (["a", "b"], ["a", "x"], ["github.com/a/b"])


def test_capture_log(spark):
    o = spark.createDataFrame([(1, "click", "opened", "a.png"), (1, "click", "opened", "../outside.png"), (2, "", "x", "a.png"), (3, "tap", "shown", "a.png")], "log int, action string, observation string, artifact string")
    f = spark.createDataFrame([("a.png",)], "path string")
    assert {r.log: (r.valid, r.status) for r in inventory.capture_summary(o, f).collect()} == {1: (1, "partial"), 2: (0, "invalid"), 3: (1, "available")}


@pytest.mark.parametrize("path,inside", [("/a/b/c", True), ("/a/bc", False), ("/a/b", True), ("/a/b/", True), ("/x", False)])
def test_folders(spark, path, inside):
    roots = spark.createDataFrame([("/a/b/",)], "root string")
    assert evidence.outside(spark.createDataFrame([(path,)], "path string"), roots).count() == int(not inside)


def test_templates_stages_and_toml(spark):
    p = spark.createDataFrame([("a", "Podcast"), ("b", "odd")], "profile_id string, medium string")
    got = [(r.profile_id, r.position, r.hard_constraint) for r in evidence.evaluation_template(p).orderBy("profile_id", "position").collect()]
    assert got == [("a", 0, True), ("a", 1, True), ("a", 2, False), ("a", 3, False), ("b", 0, True), ("b", 1, True), ("b", 2, False), ("b", 3, True)]
    s = spark.sql("SELECT map('text', named_struct('status', 'complete', 'host_review_required', false), 'ocr', named_struct('status', 'partial', 'host_review_required', true)) AS s")
    assert tuple(s.select(*evidence.stage_rollup(F.col("s"), ["text", "ocr"])).first()) == ("partial", ["ocr"])
    assert s.select(evidence.stage_rollup(F.col("s"), ["text", "none"])[0]).first()[0] == "failed"
    t = spark.createDataFrame([("x/pyproject.toml", '[project]\nname = "p"\ndependencies = ["b>=1", "a"]'), ("Cargo.toml", '[package]\nname = "c"\n[dependencies]\nserde = "1"'), ("y/pyproject.toml", "[")], "path string, text string")
    assert {r.path: (r.name, r.dependencies, r.status) for r in inventory.toml_dependencies(t).collect()} == {"x/pyproject.toml": ("p", ["a", "b"], "complete"), "Cargo.toml": ("c", ["serde"], "complete"), "y/pyproject.toml": (None, [], "parse_failed")}


def test_budget_of_results(spark):
    from evidex.operators import library

    rows = spark.createDataFrame([(k, "x" * 50) for k in range(5)], "rank int, text string")
    one = len('{"rank":0,"text":"' + "x" * 50 + '"}') + 2
    assert library.within_budget(rows, [F.col("rank")], 2 + 3 * one).count() == 3
