
import numpy as np
import pytest
from pyspark.sql import functions as F

from evidex.operators import corpus, inventory, media, runs, status
from evidex.sources import files, sinks


def test_gate_from_headers_to_status(spark):
    """A run with evidence only is in progress; one with all stages of its mode is complete."""
    rows = [("a", "evidence", "complete"), ("a", "cards", "missing"), ("b", "evidence", "complete"), ("b", "cards", "complete"), ("b", "profile", "complete")]
    got = {r.run: r.overall_status for r in runs.overall(spark.createDataFrame(rows, "run string, stage string, status string"), "distillation", "run").collect()}
    assert got == {"a": "in_progress", "b": "complete"}


def test_merge_needs_two(spark):
    one = spark.createDataFrame([("m", "evidence_ready", 1, [1])], "manifest string, distillation_status string, source_count int, items array<int>")
    assert [r.rule for r in runs.merge_refusals(one).collect()] == ["two_manifests"]


def test_populated_paths(spark):
    listing = spark.createDataFrame([("x/a/b.txt", 3), ("y/empty", 0)], "path string, length int")
    asked = spark.createDataFrame([("x",), ("x/a/",), ("x/a/b.txt",), ("y",), ("x/b",)], "path string")
    assert {r.path for r in runs.populated(asked, listing).collect()} == {"x", "x/a/", "x/a/b.txt"}


def test_statuses(spark):
    row = spark.range(1).select(
        status.worst(status.image_stages(F.lit(True), F.lit(True), F.lit(False))).alias("image"),
        status.to_review(status.image_stages(F.lit(True), F.lit(True), F.lit(False))).alias("review"),
        status.worst(status.stages(a=status.stage("odd"))).alias("odd"),
        status.worst(status.stages(a=status.stage("complete")), F.array(F.lit("a"), F.lit("b"))).alias("missing"),
    ).first()
    assert (row.image, row.review, row.odd, row.missing) == ("partial", ["ocr"], "failed", "failed")


def test_manifests(spark):
    rows = [("a/Cargo.toml", '[package]\nname = "k"\n[dependencies]\nserde = "1"\n'), ("pyproject.toml", '[project]\nname = "p"\ndependencies = ["numpy>=1", "x y"]\n[tool.poetry.dependencies]\nrich = "*"\n'), ("b/pyproject.toml", "= broken"), ("c/pyproject.toml", "project = 3")]
    got = {r.path: (r.name, r.dependencies, r.status) for r in inventory.toml_dependencies(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {"a/Cargo.toml": ("k", ["serde"], "complete"), "pyproject.toml": ("p", ["numpy", "rich", "x"], "complete"), "b/pyproject.toml": (None, [], "parse_failed"), "c/pyproject.toml": (None, [], "complete")}
    r = spark.range(1).select(inventory.package_scripts(F.lit('{"scripts": {"t": "x", "b": "y"}}')).alias("s"), inventory.go_module(F.lit("// x\nmodule example.org/a\n\ngo 1.2")).alias("m")).first()
    assert r.s == ["b", "t"] and r.m == "example.org/a"


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_bytes(b'\xef\xbb\xbf{"id": "x",\n "n": 1}')
    (tmp_path / "in" / "b.json").write_text("{broken")
    (tmp_path / "in" / "c.pdf").write_bytes(b"%PDF")
    (tmp_path / "in" / "d.md").write_text("# T\ntext")
    (tmp_path / "in" / "e.ass").write_text("[Events]\nDialogue: 0,0:00:01.50,0:00:02.00,Default,,0,0,0,,{\\i1}Hello,\\Nyou\n")
    (tmp_path / "in" / "empty.txt").write_text(" ")
    got = {r.path.rsplit("/", 1)[-1]: (r.id, r.n, r.status) for r in files.load_json(spark, f"{tmp_path}/in", "id string, n int").collect()}
    assert got == {"a.json": ("x", 1, "complete"), "b.json": (None, None, "failed")}
    docs = {r.path.rsplit("/", 1)[-1]: (r.text, r.status) for r in files.documents(spark, f"{tmp_path}/in").collect()}
    assert docs["c.pdf"] == ("", "not_applicable") and docs["empty.txt"][1] == "partial" and docs["e.ass"] == ("Hello, you", "complete")
    cues = files.ass_cues(spark.createDataFrame([("k", (tmp_path / "in" / "e.ass").read_text())], "path string, text string"), "path").collect()
    assert [(r.start, r.end, r.text) for r in cues] == [(1.5, 2.0, "Hello, you")]
    assert [r.path.rsplit("/", 1)[-1] for r in files.markdown_files(spark, f"{tmp_path}/in").collect()] == ["d.md"]
    listed = files.find_files(spark, f"{tmp_path}/in")
    with pytest.raises(ValueError):
        files.within(listed, "document", most=2)
    assert files.within(listed, "document").count() == 6
    assert {r.relative_path for r in files.small_texts(listed).select("relative_path").collect()} == {r.relative_path for r in listed.select("relative_path").collect()}
    out = sinks.prepared(spark, f"{tmp_path}/out")
    sinks.write_json(listed.select("relative_path"), f"{out}/list")
    with pytest.raises(FileExistsError):
        sinks.prepared(spark, f"{tmp_path}/out")
    assert sinks.prepared(spark, f"{tmp_path}/out", resume=True) and spark.read.json(f"{out}/list").count() == 6
    sinks.write_texts(spark.createDataFrame([("n", "body")], "name string, text string"), f"{out}/texts")
    assert spark.read.text(f"{out}/texts").first().value == "body"
    assert sinks.exit_status(spark.createDataFrame([("complete",), ("failed",)], "status string")) == 1


def test_index_version(spark, tmp_path):
    spark.createDataFrame([(2, "a")], "schema_version int, token string").write.parquet(f"{tmp_path}/i")
    assert files.load_index(spark, f"{tmp_path}/i", "token string").first().token == "a"
    with pytest.raises(ValueError):
        files.load_index(spark, f"{tmp_path}/i", "token string", version=3)


def test_motion_and_images(spark):
    rng = np.random.default_rng(1)
    frame = rng.integers(0, 255, (24, 32), dtype=np.uint8)
    rows = [("s", i / 2, 32, 24, bytearray(np.roll(frame, 4 * i, 1).tobytes())) for i in range(3)]
    got = media.motion_pairs(spark.createDataFrame(rows, "id string, at double, width int, height int, pixels binary"), "id", "at").orderBy("start").collect()
    assert [(r.start, r.end) for r in got] == [(0.0, 0.5), (0.5, 1.0)] and all(abs(abs(r.dx) - 2 * 4 / 32) < 1e-9 and r.dy == 0 for r in got)
    r = spark.range(1).select(media.correlation(F.array(*map(F.lit, [1, 2, 4])), F.array(*map(F.lit, [2, 4, 8]))).alias("one"), media.correlation(F.array(F.lit(1), F.lit(1)), F.array(F.lit(1), F.lit(2))).alias("none")).first()
    assert abs(r.one - 1) < 1e-12 and r.none is None


def test_quantiles_without_a_groups_values(spark):
    rng = np.random.default_rng(2)
    rows = [(g, float(x)) for g, n in (("a", 1), ("b", 7), ("c", 500)) for x in rng.normal(size=n).round(1)] + [("a", None)]
    got = corpus.quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", {"q1": 0.25, "q9": 0.9}).collect()
    for r in got:
        v = [x for g, x in rows if g == r.g and x is not None]
        assert r.n == len(v) and np.allclose((r.q1, r.q9, r.mean, r.largest), (np.quantile(v, 0.25), np.quantile(v, 0.9), np.mean(v), max(v)))


@pytest.mark.parametrize("blocks", [None, 6, 7, 8, 10])
def test_hamming_pairs_of_any_key_length(spark, blocks):
    rng = np.random.default_rng(3)
    base = rng.integers(-(1 << 63), 1 << 63, 60, dtype=np.int64)
    hashes = [*base.tolist(), *[int(np.int64(h) ^ np.int64(sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 8), replace=False)))) for h in base]]
    df = spark.createDataFrame(list(enumerate(hashes)), "id bigint, h bigint")
    want = {(i, j, d) for i in range(len(hashes)) for j in range(i + 1, len(hashes)) if (d := ((hashes[i] ^ hashes[j]) & (2**64 - 1)).bit_count()) <= 5}
    assert {(r.left_id, r.right_id, r.distance) for r in corpus.hamming_pairs(df, "id", "h", 5, blocks=blocks).collect()} == want


@pytest.mark.parametrize("parcel", [32_768, 50])
def test_hamming_pairs_of_many_bits_meet_in_parcels(spark, monkeypatch, parcel):
    """Beyond 6 bits hashes aren't joined on keys of a few bits, where each meets a large part of all others."""
    monkeypatch.setattr(corpus, "PARCEL", parcel, raising=False)
    rng = np.random.default_rng(4)
    base = rng.integers(-(1 << 63), 1 << 63, 80, dtype=np.int64)
    hashes = [*base.tolist(), *base[:9].tolist(), -(1 << 63), 0, *[int(np.int64(h) ^ np.int64(sum(1 << int(b) for b in rng.choice(63, rng.integers(10, 22), replace=False)))) for h in base]]
    df = spark.createDataFrame([*enumerate(hashes), (999, None)], "id bigint, h bigint")
    want = {(i, j, d) for i in range(len(hashes)) for j in range(i + 1, len(hashes)) if (d := ((hashes[i] ^ hashes[j]) & (2**64 - 1)).bit_count()) <= 16}
    found = corpus.hamming_pairs(df, "id", "h", 16)
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(want) and set(got) == want
    assert "value" not in found._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("blocks", [6, 7, 8])
def test_hamming_pairs_gather_no_rows_in_the_driver(spark, blocks):
    """No side is broadcast, however small, and two hashes come out once though they share many bands."""
    hashes = [0, 0, 1, 3, 7, -1, -2, 1 << 40, -(1 << 63)]
    found = corpus.hamming_pairs(spark.createDataFrame(list(enumerate(hashes)), "id bigint, h bigint"), "id", "h", 5, blocks=blocks)
    got = [tuple(r) for r in found.collect()]
    want = {(i, j, d) for i in range(len(hashes)) for j in range(i + 1, len(hashes)) if (d := ((hashes[i] ^ hashes[j]) & (2**64 - 1)).bit_count()) <= 5}
    assert len(got) == len(want) and set(got) == want
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
