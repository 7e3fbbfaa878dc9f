"""Queries over events, conversations and orders, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidex.operators import timeline as L
from evidex.sources.tables import table

T0 = 1704067200.0  # seconds of 2024-01-01, where the events start


def _events(spark, d):
    e = table(spark, d, "events")
    at = F.round(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - T0, 3)
    return e.select("event_id", "user_id", "event_type", "value", at.alias("sec"))


EVENTS = f"e AS (SELECT event_id, user_id, event_type, value, round(epoch_us(ts) / 1e6 - {T0}, 3) AS sec FROM events)"


def run_collapse(spark, d):
    rows = _events(spark, d).withColumn("text", F.when(F.col("value") < 5, " ").otherwise(F.upper("event_type")))
    return L.collapse_runs(rows, "user_id", ["sec", "event_id"], "sec", "text")


def gap_intervals(spark, d):
    rows = _events(spark, d).select("user_id", F.col("sec").alias("start"), (F.col("sec") + 20 * F.abs("value")).alias("end"))
    out = L.gaps(rows, "user_id")
    return out.select("user_id", F.round("gap_start", 3).alias("gap_start"), F.round("gap_end", 3).alias("gap_end"))


def adjacent_rate(spark, d):
    return L.adjacent_rate(_events(spark, d), "user_id", ["sec", "event_id"], "sec", "value").select("event_id", F.round("rate", 6).alias("rate"))


def _spans(spark, d):
    return _events(spark, d).groupBy("user_id").agg((F.max("sec") - F.min("sec")).alias("span")).select("user_id", F.round("span", 3).alias("span"))


def fixed_segments(spark, d):
    return L.fixed_segments(_spans(spark, d), "user_id", "span", 86400.0)


def interval_points(spark, d):
    return L.interval_points(_spans(spark, d), "user_id", "span", 3600.0, 100).withColumnRenamed("at", "sec")


def even_sample(spark, d):
    return L.evenly_spaced(_events(spark, d), ["user_id"], ["sec", "event_id"], 7).select("event_id", "user_id")


def phase_samples(spark, d):
    return L.phase_samples(fixed_segments(spark, d), "user_id", 5, 40)


def timeline_union(spark, d):
    e = _events(spark, d).select(F.lit("event").alias("kind"), "sec", F.col("event_id").alias("id"), F.col("event_type").alias("label"))
    c = table(spark, d, "conversations").select(F.lit("turn").alias("kind"), F.col("turn").cast("double").alias("sec"), F.col("conv_id").alias("id"), "text")
    return L.timeline(e, c, order=["sec", "kind", "id"])


def segment_stats(spark, d):
    return L.segment_stats(fixed_segments(spark, d), "user_id").select("user_id", "n", F.round("mean", 6).alias("mean"), "median", "least", "most")


def dominant_type(spark, d):
    return L.dominant(_events(spark, d), "user_id", "event_type", "value").select("user_id", "dominant", F.round("mean_confidence", 4).alias("mean_confidence"))


def type_hist(spark, d):
    return _events(spark, d).groupBy("event_type").agg(F.count("*").alias("n"))


def status_rollup(spark, d):
    status = F.when(F.col("value") < 10, "complete").when(F.col("value") < 40, "degraded").when(F.col("value") < 80, "partial").otherwise("odd")
    return L.status_counts(_events(spark, d).withColumn("status", status), ["event_type", "user_id"], "status")


def merge_ids(spark, d):
    c = table(spark, d, "conversations").select(F.concat(F.col("role"), F.lit("-"), (F.col("conv_id") % 40).cast("string")).alias("id"), (F.col("turn") + 1).alias("source"), "conv_id", "turn")
    return L.unique_ids(c, "id", "source", ["conv_id"]).select("conv_id", "turn", "merged_id", "analysis_id")


def sequence_corr(spark, d):
    e = table(spark, d, "embeddings").select("label", F.posexplode(F.slice("embedding", 1, 32)).alias("i", "x"), F.expr("slice(embedding, 33, 32)").alias("r")).select("label", F.col("x").cast("double").alias("x"), F.expr("cast(r[i] as double)").alias("y"))
    return L.sequence_similarity(e, ["label"], "x", "y").select("label", F.round("similarity", 6).alias("similarity"))


def movement_names(spark, d):
    """Motion names of the first vectors' components, read as shifts, change of scale and rotation."""
    v = F.col("embedding")
    x, y, s, r = (v[i].cast("double") / k for i, k in ((0, 10.0), (1, 10.0), (2, 20.0), (3, 0.2)))
    return table(spark, d, "embeddings").select("vec_id", L.movement(x, y, s, r).alias("movement"), F.round(L.motion_confidence(F.col("vec_id") % 50, F.lit(60), F.abs(x)), 6).alias("confidence"))


def transcripts(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", (F.col("turn") * 2.5).alias("start"), (F.col("turn") * 2.5 + 2.25).alias("end"), "text")
    return L.transcript(rows, "conv_id").select("conv_id", F.md5("transcript").alias("transcript_md5"))


SEG = f"{EVENTS}, sp AS (SELECT user_id, round(max(sec) - min(sec), 3) AS span FROM e GROUP BY user_id), i AS (SELECT user_id, span, unnest(range(greatest(1, CAST(ceil(span / 86400.0) AS BIGINT)))) AS i FROM sp), seg AS (SELECT user_id, CAST(i + 1 AS INTEGER) AS index, round(i * 86400.0, 3) AS start, round(CASE WHEN span > 0 THEN least(span, i * 86400.0 + 86400.0) ELSE i * 86400.0 + 86400.0 END, 3) AS \"end\", round(CASE WHEN span > 0 THEN least(span, i * 86400.0 + 86400.0) ELSE i * 86400.0 + 86400.0 END - i * 86400.0, 3) AS duration FROM i)"
_places = "list_transform(range({m}), lambda k: CAST(round_even(k * (n - 1) / {m1}.0, 0) AS BIGINT))"
_clock = "printf('%02d:%02d:%02d.%03d', ms // 3600000, (ms // 60000) % 60, (ms // 1000) % 60, ms % 1000)"


def _clk(x):
    return _clock.replace("ms", f"CAST(round({x} * 1000) AS BIGINT)")


QUERIES = {
    "run_collapse": (run_collapse, f"WITH {EVENTS}, k AS (SELECT *, lower(event_type) AS k, upper(event_type) AS text FROM e WHERE NOT value < 5), m AS (SELECT *, CASE WHEN k = lag(k) OVER w THEN 0 ELSE 1 END AS new FROM k WINDOW w AS (PARTITION BY user_id ORDER BY sec, event_id)), r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY sec, event_id ROWS UNBOUNDED PRECEDING) AS run FROM m) SELECT user_id, CAST(run AS BIGINT) AS run, min(sec) AS start, max(sec) AS \"end\", min(text) AS text, count(*) AS n FROM r GROUP BY user_id, run"),
    "gap_intervals": (gap_intervals, f"WITH {EVENTS}, i AS (SELECT user_id, sec AS start, sec + 20 * abs(value) AS \"end\" FROM e), g AS (SELECT user_id, start AS gap_end, max(\"end\") OVER (PARTITION BY user_id ORDER BY start, \"end\" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap_start FROM i) SELECT user_id, round(gap_start, 3) AS gap_start, round(gap_end, 3) AS gap_end FROM g WHERE gap_start < gap_end"),
    "adjacent_rate": (adjacent_rate, f"WITH {EVENTS}, n AS (SELECT *, lead(value) OVER w AS v, lead(sec) OVER w AS t FROM e WINDOW w AS (PARTITION BY user_id ORDER BY sec, event_id)) SELECT event_id, round(CASE WHEN t > sec THEN abs(v - value) / (t - sec) END, 6) AS rate FROM n WHERE t IS NOT NULL"),
    "fixed_segments": (fixed_segments, f"WITH {SEG} SELECT * FROM seg"),
    "interval_points": (interval_points, f"WITH {EVENTS}, sp AS (SELECT user_id, round(max(sec) - min(sec), 3) AS d FROM e GROUP BY user_id), b AS (SELECT user_id, d, CASE WHEN ceil(d / 3600.0) > 100 THEN d / 100 ELSE 3600.0 END AS step FROM sp WHERE d > 0), p AS (SELECT *, unnest(range(CAST(least(ceil(d / step), 100) AS BIGINT))) AS point FROM b) SELECT user_id, CAST(point AS INTEGER) AS point, round(greatest(0.0, least(d - 0.001, point * step + step / 2)), 3) AS sec FROM p"),
    "even_sample": (even_sample, f"WITH {EVENTS}, r AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY sec, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM e) SELECT event_id, user_id FROM r WHERE n <= 7 OR list_contains({_places.format(m=7, m1=6)}, i)"),
    "phase_samples": (phase_samples, f"WITH {SEG}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY index) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM seg), c AS (SELECT * FROM r WHERE n <= 8 OR list_contains({_places.format(m=8, m1=7)}, i)), p(k, phase, f) AS (VALUES {', '.join(f'({k}, {chr(39)}{p}{chr(39)}, CAST({f} AS DOUBLE))' for k, (p, f) in enumerate(L.PHASES[5]))}), x AS (SELECT user_id, index AS scene_index, phase, round(start + greatest(0.0, \"end\" - start) * f, 3) AS timestamp, row_number() OVER (PARTITION BY user_id ORDER BY index, k) AS r FROM c CROSS JOIN p) SELECT user_id, scene_index, phase, timestamp FROM x WHERE r <= 40"),
    "timeline_union": (timeline_union, f"WITH {EVENTS} SELECT 'event' AS kind, sec, event_id AS id, event_type AS label, NULL AS text FROM e UNION ALL SELECT 'turn', CAST(turn AS DOUBLE), conv_id, NULL, text FROM conversations"),
    "segment_stats": (segment_stats, f"WITH {SEG}, r AS (SELECT user_id, duration AS v, row_number() OVER (PARTITION BY user_id ORDER BY duration) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM seg) SELECT user_id, count(*) AS n, round(avg(v), 6) AS mean, max(v) FILTER (r = n // 2 + 1) AS median, min(v) AS least, max(v) AS most FROM r GROUP BY user_id"),
    "dominant_type": (dominant_type, f"WITH {EVENTS}, g AS (SELECT user_id, event_type, count(*) AS n FROM e GROUP BY user_id, event_type), c AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS r FROM g), m AS (SELECT user_id, round(avg(value), 4) AS mean_confidence FROM e GROUP BY user_id) SELECT user_id, event_type AS dominant, mean_confidence FROM c JOIN m USING (user_id) WHERE r = 1"),
    "type_hist": (type_hist, "SELECT event_type, count(*) AS n FROM events GROUP BY event_type"),
    "status_rollup": (status_rollup, f"WITH {EVENTS}, s AS (SELECT event_type, user_id, CASE WHEN value < 10 THEN 'complete' WHEN value < 40 THEN 'degraded' WHEN value < 80 THEN 'partial' ELSE 'odd' END AS s FROM e) SELECT event_type, user_id, 0::BIGINT AS not_applicable_count, count(*) FILTER (s = 'complete') AS complete_count, count(*) FILTER (s = 'degraded') AS degraded_count, count(*) FILTER (s = 'partial') AS partial_count, count(*) FILTER (s = 'odd') AS failed_count, CASE WHEN count(*) FILTER (s = 'partial') > 0 THEN 'partial' WHEN count(*) FILTER (s = 'degraded') > 0 THEN 'degraded' WHEN count(*) FILTER (s = 'complete') > 0 THEN 'complete' ELSE 'not_applicable' END AS overall FROM s GROUP BY event_type, user_id"),
    "merge_ids": (merge_ids, "WITH c AS (SELECT role || '-' || (conv_id % 40) AS id, turn + 1 AS source, conv_id, turn FROM conversations), b AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY id ORDER BY source, conv_id) > 1 THEN 'source-' || source || '-' || id ELSE id END AS base FROM c), k AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY source, conv_id) AS k FROM b), m AS (SELECT *, CASE WHEN k > 1 THEN base || '-' || k ELSE base END AS merged_id FROM k) SELECT conv_id, turn, merged_id, CASE WHEN merged_id <> id THEN id END AS analysis_id FROM m"),
    "sequence_corr": (sequence_corr, "WITH e AS (SELECT label, CAST(unnest(embedding[1:32]) AS DOUBLE) AS x, CAST(unnest(embedding[33:64]) AS DOUBLE) AS y FROM embeddings) SELECT label, round(coalesce((corr(x, y) + 1) / 2, 0.0), 6) AS similarity FROM e GROUP BY label"),
    "movement_names": (movement_names, "WITH v AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) / 10.0 AS x, CAST(embedding[2] AS DOUBLE) / 10.0 AS y, CAST(embedding[3] AS DOUBLE) / 20.0 AS s, CAST(embedding[4] AS DOUBLE) / CAST(0.2 AS DOUBLE) AS r FROM embeddings) SELECT vec_id, CASE WHEN abs(s) >= 0.012 THEN CASE WHEN s > 0 THEN 'push_or_zoom_in' ELSE 'pull_or_zoom_out' END WHEN abs(r) >= 0.8 THEN CASE WHEN r > 0 THEN 'roll_clockwise' ELSE 'roll_counterclockwise' END WHEN sqrt(x * x + y * y) < 0.0025 AND abs(s) < 0.004 AND abs(r) < 0.25 THEN 'static_or_stabilized' WHEN abs(x) >= abs(y) THEN CASE WHEN x > 0 THEN 'pan_left_likely' ELSE 'pan_right_likely' END WHEN y > 0 THEN 'tilt_up_likely' ELSE 'tilt_down_likely' END AS movement, round((vec_id % 50) / 60.0 * CASE WHEN abs(x) > 0.01 THEN CAST(0.7 AS DOUBLE) ELSE 1.0 END, 6) AS confidence FROM v"),
    "transcripts": (transcripts, f"WITH s AS (SELECT conv_id, turn * 2.5 AS a, turn * 2.5 + 2.25 AS b, text FROM conversations) SELECT conv_id, md5(string_agg('[' || {_clk('a')} || '-' || {_clk('b')} || '] ' || text, chr(10) ORDER BY a, b, text)) AS transcript_md5 FROM s GROUP BY conv_id"),
}
