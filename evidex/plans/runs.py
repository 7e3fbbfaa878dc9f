"""Queries of run gates, bindings, status rules and image likeness, with their SQL.

The tables hold no runs, so they are made from documents, conversations, events and
embeddings; every rule meets rows that break it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from evidex.functions import text as T
from evidex.operators import evidence, inventory, media, runs, status, timeline
from evidex.plans import evidence as cards
from evidex.plans.documents import q, sql_squeezed
from evidex.sources import files
from evidex.sources.tables import table

c = F.col


def _said(spark, d):
    """Turns read as patterns: the role is the key, a conversation the source."""
    t = table(spark, d, "conversations")
    trigger = F.concat(F.lit("Turn "), (c("turn") % 5).cast("string"))
    return t.select(c("conv_id").alias("source_id"), c("turn").alias("position"), c("role").alias("key"), c("text").alias("statement"), F.when(c("turn") % 2 == 0, F.upper("role")).otherwise(c("role")).alias("mechanism"), trigger.alias("trigger"), F.when(c("conv_id") % 3 == 0, " ").otherwise("in  talks").alias("boundary"), (c("conv_id") % 7 != 0).alias("transferable"))


def pattern_lists(spark, d):
    return evidence.listed(_said(spark, d)).select("key", "field", "place", F.md5("value").alias("value_md5"), "source_id")


def first_patterns(spark, d):
    rows = table(spark, d, "documents").select("lang", F.concat_ws(".", "lang", "source", (c("doc_id") % 9).cast("string")).alias("key")).distinct()
    return runs.first_keys(rows, ["lang"])


def frame_samples(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", F.unix_timestamp("ts").cast("double").alias("at"), "event_type")
    samples = e.where("event_id % 3 <> 0").select("user_id", "at", "event_id", c("event_type").alias("phase"))
    return runs.annotated(e.select("event_id", "user_id", "at"), samples, ["user_id"], "at", "event_id", ["phase"]).select("event_id", "phase")


def _id(x):
    return F.concat(F.lit("doc-"), x.cast("string"))


def card_bindings(spark, d):
    """Documents are cards, pages the files: some cards are repeated, unregistered, cite themselves, or what isn't there."""
    doc = table(spark, d, "documents")
    sid = _id(c("doc_id") - F.when(c("doc_id") % 97 == 96, 1).otherwise(0))
    path = F.concat(F.lit("cards/"), c("doc_id").cast("string"))
    art = F.when(c("doc_id") % 31 == 0, path).otherwise(F.concat(F.lit("site/"), (c("doc_id") % 211).cast("string"), F.lit("/")))
    pattern = F.struct(F.array(F.struct(art.alias("artifact"))).alias("evidence"))
    cards = doc.where("doc_id % 53 <> 0").select(sid.alias("source_id"), path.alias("path"), F.concat(F.lit("a/"), (c("doc_id") + F.when(c("doc_id") % 41 == 0, 1).otherwise(0)).cast("string")).alias("analysis_artifact"), F.array(pattern).alias("patterns"))
    items = doc.where("doc_id % 59 <> 0").select(_id(c("doc_id")).alias("id"), F.concat(F.lit("a/"), c("doc_id").cast("string")).alias("analysis"))
    pages = table(spark, d, "pages").select(F.concat(F.lit("site/"), (c("page_id") % 199).cast("string"), F.lit("/x.html")).alias("path"), F.lit(1).alias("length"))
    held = doc.select(path.alias("path"), F.lit(9).alias("length"))
    return runs.card_bindings(cards, items, pages.unionAll(held))


_BIND = """
WITH cd AS (SELECT 'doc-' || (doc_id - CASE WHEN doc_id % 97 = 96 THEN 1 ELSE 0 END) AS sid, 'cards/' || doc_id AS path, 'a/' || (doc_id + CASE WHEN doc_id % 41 = 0 THEN 1 ELSE 0 END) AS an,
  doc_id % 31 = 0 AS self, doc_id % 211 AS site FROM documents WHERE doc_id % 53 <> 0),
it AS (SELECT 'doc-' || doc_id AS sid, 'a/' || doc_id AS an FROM documents WHERE doc_id % 59 <> 0)
SELECT sid AS entity, 'card_unique' AS rule FROM cd GROUP BY sid HAVING count(*) > 1
UNION ALL SELECT cd.sid, 'analysis_matches' FROM cd LEFT JOIN it USING (sid) WHERE it.an IS NULL OR it.an <> cd.an
UNION ALL SELECT DISTINCT sid, 'evidence_there' FROM cd WHERE NOT self AND site NOT IN (SELECT page_id % 199 FROM pages)
UNION ALL SELECT DISTINCT sid, 'no_self_citation' FROM cd WHERE self
UNION ALL SELECT sid, 'card_missing' FROM it WHERE sid NOT IN (SELECT sid FROM cd)
UNION ALL SELECT DISTINCT sid, 'card_registered' FROM cd WHERE sid NOT IN (SELECT sid FROM it)
"""


def profile_sources(spark, d):
    doc, sid = table(spark, d, "documents"), _id(c("doc_id"))
    ids = lambda k: doc.where(f"doc_id % {k} <> 0").select(sid.alias("source_id"))
    out = lambda k, reason: doc.where(f"doc_id % {k} = 0").select(sid.alias("source_id"), reason.alias("reason"))
    return runs.profile_sources(ids(7), ids(11), out(13, F.when(c("doc_id") % 39 == 0, "other").otherwise(c("lang"))), out(26, c("lang")))


def evaluation_bindings(spark, d):
    conv = table(spark, d, "conversations").where("turn = 0")
    run = conv.where("conv_id % 19 <> 0").select(c("conv_id").alias("run_id"), F.lit("profile-a").alias("profile_id"), T.squeezed("text").alias("objective"), F.concat(F.lit("out/"), c("conv_id").cast("string")).alias("candidate"))
    e = conv.select(c("conv_id").alias("run_id"), c("conv_id").alias("evaluation_id"), F.when(c("conv_id") % 5 == 0, "profile-b").otherwise("profile-a").alias("profile_id"), F.concat(F.lit("  "), c("text"), F.when(c("conv_id") % 7 == 0, "x").otherwise("")).alias("objective"), F.concat(F.lit("out/"), (c("conv_id") - F.when(c("conv_id") % 11 == 0, 1).otherwise(0)).cast("string")).alias("candidate"))
    return runs.evaluation_bindings(e, run)


def run_headers(spark, d):
    doc = table(spark, d, "documents")
    k = lambda n: c("doc_id") % n == 0
    lists = F.struct(F.when(k(13), F.lit(None).cast("array<string>")).otherwise(F.array(F.lit("m.json"))).alias("manifests"))
    made = doc.select(
        c("doc_id").alias("run_id"), F.when(k(3), 2).otherwise(1).alias("schema_version"), F.when(k(5), "reading").when(k(2), "application").otherwise("distillation").alias("mode"),
        F.when(k(7), " short ").otherwise("learn how it is made").alias("objective"), F.when(k(11), F.array(F.lit("-"))).otherwise(F.array("lang")).alias("domains"), F.when(k(17), F.lit(None)).otherwise(lists).alias("artifacts"),
    )
    return runs.header_violations(made)


def ready_payloads(spark, d):
    k = lambda n: c("doc_id") % n == 0
    some = F.array(F.lit("x"))
    payload = {
        "distillation_status": F.when(k(3), "draft").otherwise("evidence_ready"), "status_scope": F.when(k(5), "n/a").otherwise("extraction"), "kind": F.when(k(2), "document-analysis"),
        "items": F.when(k(4), some), "id": _id(c("doc_id")), "semantic_review_required": F.when(k(7), F.slice(some, 1, 0)).when(~k(2), some),
    }
    return table(spark, d, "documents").select("doc_id", runs.evidence_ready(payload).alias("ready"))


def candidate_checks(spark, d):
    p = table(spark, d, "pages")
    made = p.select("page_id", F.when(c("page_id") % 9 == 0, " ").when(c("page_id") % 2 == 0, F.concat(F.lit("out/"), (c("page_id") % 30).cast("string"), F.lit("/"))).otherwise(F.concat(F.lit("out/"), c("page_id").cast("string"), F.lit(".md"))).alias("candidate"))
    there = p.select(F.when(c("page_id") % 3 == 0, F.concat(F.lit("out/"), c("page_id").cast("string"), F.lit(".md"))).otherwise(F.concat(F.lit("out/"), (c("page_id") % 25).cast("string"), F.lit("/deep/x"))).alias("path"), (c("page_id") % 4).alias("length"))
    return runs.candidate_violations(made, there, "page_id")


def run_routes(spark, d):
    words = F.slice(F.array_distinct(F.transform(F.split(F.lower("text"), "[^a-z]+"), lambda w: F.substring(w, 1, 2))), 1, 6)
    routes = table(spark, d, "conversations").where("turn = 0").select(c("conv_id").alias("route"), words.alias("components"))
    have = table(spark, d, "conversations").where("turn = 1").select(F.explode(F.transform(F.split(F.lower("text"), "[^a-z]+"), lambda w: F.substring(w, 1, 2))).alias("component"))
    return runs.missing_components(routes, have.distinct())


def merge_refusals(spark, d):
    own = c("doc_id") - F.when(c("doc_id") % 10 == 9, 1).otherwise(0)
    made = table(spark, d, "documents").select(F.concat(F.lit("m-"), own.cast("string")).alias("manifest"), own.alias("doc_id")).select("manifest", F.when(c("doc_id") % 4 == 0, "draft").otherwise("evidence_ready").alias("distillation_status"), F.lit(2).alias("source_count"), F.slice(F.array(F.lit(1), F.lit(2)), 1, F.when(c("doc_id") % 6 < 2, 1).otherwise(2)).alias("items"))
    return runs.merge_refusals(made)


def run_status(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", F.element_at(F.array(*map(F.lit, runs.STAGES["application"])), (c("turn") % 5 + 1).cast("int")).alias("stage"), F.when((c("conv_id") + c("turn")) % 23 == 0, "failed").otherwise("complete").alias("status")).distinct()
    return runs.overall(rows, "distillation", "conv_id")


def contract_report(spark, d):
    return runs.report(cards._cards(spark, d), cards.card_violations(spark, d), "source_id")


def stage_status(spark, d):
    """The status each medium's rules give documents of all combinations."""
    k = lambda n: c("doc_id") % n == 0
    low = F.when(k(3), c("doc_id") % 4)
    one = status.document_stages(~k(5), low, c("doc_id") % 2, c("doc_id") % 7)
    two = status.image_stages(~k(4), ~k(3), ~k(2))
    three = status.audio_stages(F.when(k(6), "partial").when(k(10), "degraded").otherwise("complete"), ~k(3), ~k(5))
    need = status.video_required(k(2), k(3), k(5), k(7))
    many = status.stages(**{n: status.stage(F.element_at(F.array(*map(F.lit, ["complete", "degraded", "partial"])), ((c("doc_id") + i) % 3 + 1).cast("int"))) for i, n in enumerate(["probe", "scenes", "keyframes", "motion_analysis", "transcript", "ocr"])})
    return table(spark, d, "documents").select("doc_id", status.worst(one).alias("document"), F.array_join(status.to_review(one), ",").alias("document_review"), status.worst(two).alias("image"), status.worst(three).alias("audio"), status.worst(many, need).alias("video"))


def _rank(*x):
    order = ", ".join(f"'{s}'" for s in timeline.STATUSES)
    return f"[{order}][list_max([{', '.join(f'list_position([{order}], {e})' for e in x)}])]"


_third = lambda i: f"['complete', 'degraded', 'partial'][CAST((doc_id + {i}) % 3 + 1 AS INTEGER)]"
_none = f"'{timeline.STATUSES[0]}'"
_scanned = "CASE WHEN doc_id % 3 <> 0 OR doc_id % 4 = 0 THEN 'not_applicable' WHEN doc_id % 2 = 0 THEN 'complete' ELSE 'partial' END"


def short_scenes(spark, d):
    e = table(spark, d, "events").select("event_id", F.round(F.abs("value") % 0.2, 3).alias("duration"))
    return e.select("event_id", status.scene_status(c("duration")).alias("status"))


def resumed_status(spark, d):
    doc = table(spark, d, "documents")
    before = doc.where("doc_id % 6 <> 0").select("doc_id", F.when(c("doc_id") % 5 == 0, F.lit(None)).when(c("doc_id") % 7 == 0, "odd").otherwise("degraded").alias("status"))
    return status.resumed(doc.select("doc_id"), before, "doc_id")


def bounded_errors(spark, d):
    made = F.concat(F.lit("cannot read /data/in/"), c("lang"), F.lit("\r\n at /data/out: "), c("text"))
    return table(spark, d, "documents").select("doc_id", T.bounded_error(made, F.concat(F.lit("/data/in/"), c("lang")), F.lit("/data/out")).alias("error"))


def inferred_kinds(spark, d):
    ends = F.array(*map(F.lit, ["a.PNG", "b.jpg", "c.mp4", "d.mov", "e.md", "f.txt", "g.bin"]))
    at = lambda x: F.element_at(ends, (x % 7 + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", media.infer_kind(at(c("doc_id")), at(F.floor(c("doc_id") / 7))).alias("kind"))


def low_text_pages(spark, d):
    return files.low_text_pages(table(spark, d, "conversations").select("conv_id", "turn", "text")).select("conv_id", "turn")


def captured_files(spark, d):
    names = F.array(*map(F.lit, ["shots/a.png", "cookies.json", "x/.hidden/y.txt", "keys/id_rsa", "id_rsa/notes.md", "my-secrets.json", ".env.local", "log.txt"]))
    rows = table(spark, d, "documents").select("doc_id", F.element_at(names, (c("doc_id") % 8 + 1).cast("int")).alias("path"))
    return inventory.captured(rows)


def ratios(spark, d):
    made = F.when(c("doc_id") % 5 == 0, c("lang")).when(c("doc_id") % 3 == 0, c("doc_id").cast("string")).otherwise(F.concat(c("doc_id").cast("string"), F.lit("/"), (c("doc_id") % 4).cast("string")))
    return table(spark, d, "documents").select("doc_id", F.round(T.ratio(made), 6).alias("ratio"))


def sidecar_files(spark, d):
    p = table(spark, d, "pages")
    name = lambda ending: F.concat(F.lit("v/clip "), c("page_id").cast("string"), F.lit(ending))
    listing = p.where("page_id % 3 = 0").select(name(".SRT").alias("path")).unionAll(p.where("page_id % 5 = 0").select(name(".ass").alias("path"))).unionAll(p.select(name(".txt").alias("path")))
    return files.sidecars(p.select(name(".mp4").alias("path")), listing)


def index_files(spark, d):
    names = F.array(*map(F.lit, ["品牌视觉.md", "a-收录.md", "notes.md", "b-蒸馏.md", "技术方案.MD"]))
    folder = F.when(c("doc_id") % 4 == 0, "cache/").when(c("doc_id") % 4 == 1, "").otherwise(F.concat("lang", F.lit("/")))
    listing = table(spark, d, "documents").select(F.concat(folder, F.element_at(names, (c("doc_id") % 5 + 1).cast("int"))).alias("relative_path"))
    return files.ordered(files.index_sources(listing, skip=("cache",)))


def _images(spark, d):
    e = c("embedding")
    x = lambda i: F.abs(e[i].cast("double"))
    bits = F.aggregate(F.transform(e, lambda v, i: F.when(v > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"), lambda a, v: a.bitwiseOR(v))
    return table(spark, d, "embeddings").select(c("vec_id").alias("id"), (c("vec_id") % 5).alias("width"), (c("vec_id") % 3).alias("height"), (x(0) + 0.5).alias("aspect"), x(1).alias("brightness"), x(2).alias("contrast"), x(3).alias("saturation"), x(4).alias("edge_density"), F.slice(e, 9, 24).alias("histogram"), F.slice(e, 33, 32).alias("layout"), bits.alias("dhash"))


def image_likeness(spark, d):
    f = _images(spark, d)
    return media.compare_images(f.select(c("id").alias("reference"), (c("id") + 1).alias("candidate")), f, "faithful")


def image_orientations(spark, d):
    return media.image_collection(_images(spark, d), ["brightness"])[0]


def image_distributions(spark, d):
    return media.image_collection(_images(spark, d), ["brightness", "contrast", "saturation", "edge_density"])[1]


_i = lambda k: f"abs(CAST(embedding[{k + 1}] AS DOUBLE))"
_bits = "list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(embedding, lambda x, i: CASE WHEN x > 0 THEN CASE WHEN i = 64 THEN -9223372036854775808 ELSE CAST(1 AS BIGINT) << CAST(i - 1 AS INTEGER) END ELSE CAST(0 AS BIGINT) END)), lambda a, b: a | b)"
IMAGES = f"im AS (SELECT vec_id AS id, vec_id % 5 AS width, vec_id % 3 AS height, {_i(0)} + 0.5 AS aspect, {_i(1)} AS brightness, {_i(2)} AS contrast, {_i(3)} AS saturation, {_i(4)} AS edge_density, list_transform(embedding[9:32], lambda v: CAST(v AS DOUBLE)) AS h, list_transform(embedding[33:64], lambda v: CAST(v AS DOUBLE)) AS l, {_bits} AS dhash FROM embeddings)"
_close = lambda m: f"exp(-abs(ln((abs(a.{m}) + 1e-6) / (abs(b.{m}) + 1e-6))))"
_bound = lambda m: f"greatest(0.0, least(1.0, 1.0 - abs(a.{m} - b.{m})))"
_cov = lambda x, y, n: f"(list_dot_product({x}, {y}) - list_sum({x}) * list_sum({y}) / {n})"
_like = lambda m, n: f"greatest(0.0, least(1.0, ({_cov('a.' + m, 'b.' + m, n)} / sqrt({_cov('a.' + m, 'a.' + m, n)} * {_cov('b.' + m, 'b.' + m, n)}) + 1) / 2))"
_measures = {
    "aspect_ratio": _close("aspect"), "color_distribution": _like("h", "24.0"), "brightness": _bound("brightness"), "contrast": _bound("contrast"), "saturation": _bound("saturation"),
    "edge_density": _close("edge_density"), "spatial_layout": _like("l", "32.0"), "perceptual_hash": "1 - bit_count(xor(a.dhash, b.dhash)) / 64.0",
}
_w = media.IMAGE_WEIGHTS["faithful"]
_norm = sql_squeezed("value")

QUERIES = {
    "pattern_lists": (pattern_lists, f"WITH s AS (SELECT * FROM conversations WHERE conv_id % 7 <> 0), x AS (SELECT conv_id, turn, role AS key, 'statement' AS field, text AS value FROM s UNION ALL SELECT conv_id, turn, role, 'mechanism', CASE WHEN turn % 2 = 0 THEN upper(role) ELSE role END FROM s UNION ALL SELECT conv_id, turn, role, 'trigger', 'Turn ' || (turn % 5) FROM s UNION ALL SELECT conv_id, turn, role, 'boundary', CASE WHEN conv_id % 3 = 0 THEN ' ' ELSE 'in  talks' END FROM s), n AS (SELECT *, {_norm} AS v FROM x), f AS (SELECT *, row_number() OVER (PARTITION BY key, field, lower(v) ORDER BY conv_id, turn) AS r FROM n WHERE v <> '') SELECT key, field, CAST(row_number() OVER (PARTITION BY key, field ORDER BY conv_id, turn) - 1 AS INTEGER) AS place, md5(v) AS value_md5, conv_id AS source_id FROM f WHERE r = 1"),
    "first_patterns": (first_patterns, "WITH k AS (SELECT DISTINCT lang, concat_ws('.', lang, source, CAST(doc_id % 9 AS VARCHAR)) AS key FROM documents) SELECT lang, key, CAST(row_number() OVER (PARTITION BY lang ORDER BY key) AS INTEGER) AS place FROM k QUALIFY place <= 12"),
    "frame_samples": (frame_samples, "WITH e AS (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS DOUBLE) AS sec, event_type FROM events), s AS (SELECT user_id, sec, arg_max(event_type, event_id) AS phase FROM e WHERE event_id % 3 <> 0 GROUP BY user_id, sec) SELECT e.event_id, s.phase FROM e LEFT JOIN s ON s.user_id = e.user_id AND s.sec = e.sec"),
    "card_bindings": (card_bindings, _BIND),
    "profile_sources": (profile_sources, "WITH x AS (SELECT doc_id, lang, 'doc-' || doc_id AS s FROM documents) SELECT s AS entity, 'source_omitted' AS rule FROM x WHERE doc_id % 11 <> 0 AND doc_id % 7 = 0 UNION ALL SELECT s, 'source_unreviewed' FROM x WHERE doc_id % 7 <> 0 AND doc_id % 11 = 0 UNION ALL SELECT s, 'exclusion_matches' FROM x WHERE doc_id % 13 = 0 AND (doc_id % 26 <> 0 OR doc_id % 39 = 0)"),
    "evaluation_bindings": (evaluation_bindings, "WITH x AS (SELECT conv_id, conv_id % 19 = 0 AS gone FROM conversations WHERE turn = 0) SELECT conv_id AS entity, 'profile_matches' AS rule FROM x WHERE gone OR conv_id % 5 = 0 UNION ALL SELECT conv_id, 'objective_matches' FROM x WHERE gone OR conv_id % 7 = 0 UNION ALL SELECT conv_id, 'candidate_matches' FROM x WHERE gone OR conv_id % 11 = 0"),
    "run_headers": (run_headers, "SELECT doc_id AS entity, 'schema_version' AS rule FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 'mode' FROM documents WHERE doc_id % 5 = 0 UNION ALL SELECT doc_id, 'objective' FROM documents WHERE doc_id % 7 = 0 UNION ALL SELECT doc_id, 'domains' FROM documents WHERE doc_id % 11 = 0 UNION ALL SELECT doc_id, 'artifacts' FROM documents WHERE doc_id % 17 = 0 UNION ALL SELECT doc_id, 'manifests' FROM documents WHERE doc_id % 13 = 0 AND doc_id % 17 <> 0"),
    "ready_payloads": (ready_payloads, "SELECT doc_id, doc_id % 3 <> 0 AND doc_id % 5 <> 0 AND (doc_id % 4 = 0 OR (doc_id % 2 <> 0 AND doc_id % 7 <> 0)) AS ready FROM documents"),
    "candidate_checks": (candidate_checks, "WITH f AS (SELECT CASE WHEN page_id % 3 = 0 THEN 'out/' || page_id || '.md' ELSE 'out/' || (page_id % 25) END AS loc FROM pages WHERE page_id % 4 > 0), r AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'out/' || (page_id % 30) ELSE 'out/' || page_id || '.md' END AS loc FROM pages WHERE page_id % 9 <> 0) SELECT CAST(page_id AS VARCHAR) AS entity, 'candidate_registered' AS rule FROM pages WHERE page_id % 9 = 0 UNION ALL SELECT CAST(page_id AS VARCHAR), 'candidate_populated' FROM r WHERE loc NOT IN (SELECT loc FROM f)"),
    "run_routes": (run_routes, "WITH t AS (SELECT conv_id, turn, list_transform(string_split_regex(lower(text), '[^a-z]+'), lambda w: substring(w, 1, 2)) AS w FROM conversations WHERE turn < 2), u AS (SELECT conv_id AS route, unnest(w) AS x, unnest(range(len(w))) AS i FROM t WHERE turn = 0), k AS (SELECT route, x, min(i) AS i FROM u GROUP BY ALL), n AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY route ORDER BY i) <= 6), h AS (SELECT DISTINCT unnest(w) AS x FROM t WHERE turn = 1), l AS (SELECT route, list_sort(list(x)) AS missing FROM n WHERE x NOT IN (SELECT x FROM h) GROUP BY route) SELECT route, coalesce(missing, []) AS missing, CASE WHEN missing IS NULL THEN 'complete' ELSE 'partial' END AS status FROM (SELECT DISTINCT route FROM u) LEFT JOIN l USING (route)"),
    "run_status": (run_status, "WITH s AS (SELECT DISTINCT conv_id, turn % 5 AS stage, (conv_id + turn) % 23 = 0 AS bad FROM conversations) SELECT conv_id, CASE WHEN count(*) FILTER (stage < 3 AND NOT bad) = 3 THEN 'complete' ELSE 'in_progress' END AS overall_status FROM s GROUP BY conv_id"),
    "contract_report": (contract_report, f"WITH v AS ({cards.QUERIES['card_violations'][1]}), b AS (SELECT entity, count(*) AS n FROM v GROUP BY entity), s AS (SELECT DISTINCT 'doc-' || doc_id AS e FROM labels JOIN documents USING (doc_id)) SELECT count(*) AS checked, count(*) FILTER (n IS NULL) AS passed, count(n) AS failed, CAST(coalesce(sum(n), 0) AS BIGINT) AS broken FROM s LEFT JOIN b ON b.entity = s.e"),
    "stage_status": (stage_status, f"SELECT doc_id, {_rank('CASE WHEN doc_id % 5 = 0 THEN ' + chr(39) + 'partial' + chr(39) + ' ELSE ' + chr(39) + 'complete' + chr(39) + ' END', _scanned)} AS document, concat_ws(',', CASE WHEN doc_id % 3 = 0 AND doc_id % 4 > 0 AND doc_id % 2 > 0 AND doc_id % 7 > 0 THEN 'scanned_pages' END, CASE WHEN doc_id % 5 = 0 THEN 'text_extraction' END) AS document_review, {_rank('CASE WHEN doc_id % 4 <> 0 THEN ' + q('complete') + ' ELSE ' + q('degraded') + ' END', 'CASE WHEN doc_id % 2 <> 0 THEN ' + q('complete') + ' WHEN doc_id % 3 <> 0 THEN ' + q('partial') + ' ELSE ' + q('not_applicable') + ' END')} AS image, {_rank('CASE WHEN doc_id % 6 = 0 THEN ' + q('partial') + ' WHEN doc_id % 10 = 0 THEN ' + q('degraded') + ' ELSE ' + q('complete') + ' END', 'CASE WHEN doc_id % 3 = 0 THEN ' + q('not_applicable') + ' WHEN doc_id % 5 <> 0 THEN ' + q('complete') + ' ELSE ' + q('partial') + ' END')} AS audio, {_rank(*[_third(i) for i in range(4)], f'CASE WHEN doc_id % 2 = 0 OR doc_id % 3 = 0 THEN {_third(4)} ELSE {_none} END', f'CASE WHEN doc_id % 5 = 0 THEN {_third(5)} ELSE {_none} END', f'CASE WHEN doc_id % 14 = 0 THEN ' + q('failed') + f' ELSE {_none} END')} AS video FROM documents"),
    "short_scenes": (short_scenes, "SELECT event_id, CASE WHEN round(abs(value) % 0.2, 3) <= 0.06 THEN 'too_short' ELSE 'usable' END AS status FROM events"),
    "resumed_status": (resumed_status, "SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'failed' WHEN doc_id % 5 = 0 THEN 'complete' WHEN doc_id % 7 = 0 THEN 'failed' ELSE 'degraded' END AS status FROM documents"),
    "bounded_errors": (bounded_errors, r"SELECT doc_id, substring(regexp_replace(regexp_replace('cannot read <source>  at <output>: ' || text, '[\r\n]+', ' ', 'g'), '^[ \t\n\r\f\x0b]+|[ \t\n\r\f\x0b]+$', '', 'g'), 1, 1000) AS error FROM documents"),
    "inferred_kinds": (inferred_kinds, "WITH x AS (SELECT doc_id, ['image', 'image', 'video', 'video', 'text', 'text', '?'][CAST(doc_id % 7 + 1 AS INTEGER)] AS a, ['image', 'image', 'video', 'video', 'text', 'text', '?'][CAST((doc_id // 7) % 7 + 1 AS INTEGER)] AS b FROM documents) SELECT doc_id, CASE WHEN a = b AND a <> '?' THEN a END AS kind FROM x"),
    "low_text_pages": (low_text_pages, r"SELECT conv_id, turn FROM conversations WHERE length(regexp_replace(text, '^[ \t\n\r\f\x0b]+|[ \t\n\r\f\x0b]+$', '', 'g')) < 30"),
    "captured_files": (captured_files, "SELECT doc_id, ['shots/a.png', 'cookies.json', 'x/.hidden/y.txt', 'keys/id_rsa', 'id_rsa/notes.md', 'my-secrets.json', '.env.local', 'log.txt'][CAST(doc_id % 8 + 1 AS INTEGER)] AS path FROM documents WHERE doc_id % 8 IN (0, 7)"),
    "ratios": (ratios, "SELECT doc_id, round(CASE WHEN doc_id % 5 = 0 THEN 0.0 WHEN doc_id % 3 = 0 THEN doc_id WHEN doc_id % 4 = 0 THEN 0.0 ELSE doc_id / CAST(doc_id % 4 AS DOUBLE) END, 6) AS ratio FROM documents"),
    "sidecar_files": (sidecar_files, "WITH s AS (SELECT page_id, 'v/clip ' || page_id || '.SRT' AS f FROM pages WHERE page_id % 3 = 0 UNION ALL SELECT page_id, 'v/clip ' || page_id || '.ass' FROM pages WHERE page_id % 5 = 0) SELECT 'v/clip ' || page_id || '.mp4' AS video, f AS subtitles, CAST(row_number() OVER (PARTITION BY page_id ORDER BY f) AS INTEGER) AS place FROM s"),
    "index_files": (index_files, "SELECT DISTINCT CASE WHEN doc_id % 4 = 1 THEN '' ELSE lang || '/' END || ['品牌视觉.md', 'a-收录.md', 'notes.md', 'b-蒸馏.md', '技术方案.MD'][CAST(doc_id % 5 + 1 AS INTEGER)] AS relative_path FROM documents WHERE doc_id % 4 <> 0 AND doc_id % 5 IN (0, 1, 3)"),
    "image_likeness": (image_likeness, f"WITH {IMAGES} SELECT a.id AS reference, b.id AS candidate, round(100.0 * ({' + '.join(f'({e}) * {_w[m]}' for m, e in _measures.items())}) / {sum(_w.values())}, 2) AS form_proxy_score, {', '.join(f'round(({e}) * 100, 2) AS {m}' for m, e in _measures.items())} FROM im a JOIN im b ON b.id = a.id + 1"),
    "image_orientations": (image_orientations, f"WITH {IMAGES} SELECT CASE WHEN width > height THEN 'landscape' WHEN width < height THEN 'portrait' ELSE 'square' END AS orientation, count(*) AS images FROM im GROUP BY 1"),
    "image_distributions": (image_distributions, f"WITH {IMAGES}, x AS (" + " UNION ALL ".join(f"SELECT '{m}' AS metric, {m} AS v FROM im" for m in ("brightness", "contrast", "saturation", "edge_density")) + ") SELECT metric, round(avg(v), 4) AS mean, round(quantile_cont(v, 0.25), 4) AS p25, round(quantile_cont(v, 0.5), 4) AS median, round(quantile_cont(v, 0.75), 4) AS p75 FROM x GROUP BY metric"),
    "merge_refusals": (merge_refusals, "WITH m AS (SELECT doc_id, 'm-' || (doc_id - CASE WHEN doc_id % 10 = 9 THEN 1 ELSE 0 END) AS m FROM documents) SELECT m AS entity, 'manifest_once' AS rule FROM m GROUP BY m HAVING count(*) > 1 UNION ALL SELECT m, 'evidence_ready' FROM m WHERE doc_id % 10 <> 9 AND doc_id % 4 = 0 UNION ALL SELECT m, 'source_count' FROM m WHERE doc_id % 10 <> 9 AND doc_id % 6 < 2"),
}
