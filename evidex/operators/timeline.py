"""Order-dependent operators over timed rows: runs, gaps, rates, segments, samples, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidex.functions import text as T

# Phases of a scene and where in it they lie, by frames per scene.
PHASES = {
    1: [("middle", 0.5)],
    2: [("opening", 0.08), ("ending", 0.92)],
    3: [("opening", 0.08), ("middle", 0.5), ("ending", 0.92)],
    4: [("opening", 0.06), ("early", 0.33), ("late", 0.67), ("ending", 0.94)],
    5: [("opening", 0.05), ("quarter", 0.25), ("middle", 0.5), ("three_quarter", 0.75), ("ending", 0.95)],
    6: [("opening", 0.04), ("early", 0.2), ("before_middle", 0.4), ("after_middle", 0.6), ("late", 0.8), ("ending", 0.96)],
    7: [("opening", 0.03), ("early", 0.17), ("first_third", 0.33), ("middle", 0.5), ("second_third", 0.67), ("late", 0.83), ("ending", 0.97)],
}
# Statuses from harmless to severe.
STATUSES = ["not_applicable", "complete", "degraded", "partial", "failed"]


def collapse_runs(rows: DataFrame, group: str, order: list[str], at: str, text: str) -> DataFrame:
    """Islands of equal text (white space and case apart); blank texts are skipped and don't break a run."""
    kept = rows.withColumn("_k", F.lower(T.compact(text))).where("_k <> ''")
    w = Window.partitionBy(group).orderBy(*order)
    marked = kept.withColumn("_new", F.coalesce((F.col("_k") != F.lag("_k").over(w)).cast("int"), F.lit(1)))
    run = marked.withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.min_by(F.col(text), F.struct(*order))
    return run.groupBy(group, "run").agg(F.min(at).alias("start"), F.max(at).alias("end"), first.alias("text"), F.count("*").alias("n"))


def gaps(intervals: DataFrame, group: str, start: str = "start", end: str = "end") -> DataFrame:
    """What no interval of a group covers between its first start and last end."""
    w = Window.partitionBy(group).orderBy(start, end)
    covered = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return intervals.select(group, F.col(start).alias("gap_end"), covered.alias("gap_start")).where("gap_start < gap_end").select(group, "gap_start", "gap_end")


def adjacent_rate(rows: DataFrame, group: str, order: list[str], at: str, value: str) -> DataFrame:
    """Change of value between a row and the next, per unit of time; null where no time passes."""
    w = Window.partitionBy(group).orderBy(*order)
    later = rows.withColumn("_v", F.lead(value).over(w)).withColumn("_t", F.lead(at).over(w)).where(F.col("_t").isNotNull())
    return later.withColumn("rate", F.when(F.col("_t") > F.col(at), F.abs(F.col("_v") - F.col(value)) / (F.col("_t") - F.col(at)))).drop("_v", "_t")


def fixed_segments(rows: DataFrame, key: str, duration: str, seconds: float) -> DataFrame:
    """Consecutive segments of `seconds` (1 at least) that cover the duration, the last one clipped; one segment for no duration."""
    step = max(1.0, seconds)
    n = F.greatest(F.lit(1), F.ceil(F.col(duration) / step)).cast("int")
    at = rows.select(key, duration, F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    start = F.col("i") * F.lit(step)
    end = F.when(F.col(duration) > 0, F.least(F.col(duration), start + step)).otherwise(start + step)
    return at.select(key, (F.col("i") + 1).alias("index"), F.round(start, 3).alias("start"), F.round(end, 3).alias("end"), F.round(end - start, 3).alias("duration"))


def interval_points(rows: DataFrame, key: str, duration: str, interval: float, most: int) -> DataFrame:
    """Middles of equal intervals, stretched where there would be more than `most`."""
    d, step = F.col(duration), max(0.25, interval)
    by = F.when(F.ceil(d / step) > most, d / most).otherwise(F.lit(step))
    n = F.least(F.ceil(d / by), F.lit(most)).cast("int")
    spread = rows.where(d > 0).select(key, d.alias("_d"), by.alias("_by"), F.explode(F.sequence(F.lit(0), n - 1)).alias("point"))
    at = F.least(F.col("_d") - 0.001, F.col("point") * F.col("_by") + F.col("_by") / 2)
    return spread.select(key, "point", F.round(F.greatest(F.lit(0.0), at), 3).alias("at"))


def evenly_spaced(rows: DataFrame, group: list[str], order: list[str], most: int) -> DataFrame:
    """At most `most` rows of each group at even places, first and last among them; halves go to the even place."""
    w = Window.partitionBy(*group)
    ranked = rows.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))
    places = F.transform(F.sequence(F.lit(0), F.lit(max(most - 1, 0))), lambda i: F.bround(i * (F.col("_n") - 1) / F.lit(float(max(most - 1, 1))), 0).cast("int"))
    return ranked.where((F.col("_n") <= most) | F.array_contains(places, F.col("_i"))).drop("_i", "_n")


def phase_samples(scenes: DataFrame, group: str, frames: int, most: int) -> DataFrame:
    """Times at the phases of evenly chosen scenes, at most `most` of each group in scene order."""
    frames = max(1, min(7, frames))
    chosen = evenly_spaced(scenes, [group], ["index"], max(1, most // frames))
    table = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(p).alias("phase"), F.lit(f).alias("f")) for k, (p, f) in enumerate(PHASES[frames])])
    each = chosen.select(group, F.col("index").alias("scene_index"), "start", "end", F.explode(table).alias("p"))
    w = Window.partitionBy(group).orderBy("scene_index", "p.k")
    timed = each.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most)
    return timed.select(group, "scene_index", F.col("p.phase").alias("phase"), F.round(F.col("start") + F.greatest(F.lit(0.0), F.col("end") - F.col("start")) * F.col("p.f"), 3).alias("timestamp"))


def upper_median(value: str) -> Column:
    """The upper one of the two middle values."""
    sorted_values = F.array_sort(F.collect_list(value))
    return F.element_at(sorted_values, F.floor(F.count(value) / 2).cast("int") + 1)


def segment_stats(segments: DataFrame, group: str, value: str = "duration") -> DataFrame:
    """n, mean, upper median, least and most of each group, by rank instead of a collected list, so that a group of any size sorts on disk."""
    w = Window.partitionBy(group)
    ranked = segments.select(group, F.col(value).alias("_v")).withColumn("_r", F.row_number().over(w.orderBy("_v"))).withColumn("_n", F.count("*").over(w))
    mid = F.max(F.when(F.col("_r") == F.floor(F.col("_n") / 2) + 1, F.col("_v")))
    return ranked.groupBy(group).agg(F.count("*").alias("n"), F.avg("_v").alias("mean"), mid.alias("median"), F.min("_v").alias("least"), F.max("_v").alias("most"))


def dominant(rows: DataFrame, group: str, item: str, confidence: str) -> DataFrame:
    """Most frequent item of each group (ties: the first by name) and the mean confidence, rows counted before the shuffle."""
    counts = rows.groupBy(group, item).agg(F.count("*").alias("n"), F.sum(confidence).alias("s"))
    return counts.groupBy(group).agg(F.min_by(item, F.struct(-F.col("n"), F.col(item))).alias("dominant"), (F.sum("s") / F.sum("n")).alias("mean_confidence"))


def status_counts(rows: DataFrame, group: list[str], status: str) -> DataFrame:
    """Rows of each status; unknown ones count as failed; and the most severe known one."""
    known = F.col(status).isin(STATUSES)
    of = F.when(known, F.col(status)).otherwise("failed")
    rank = F.array_position(F.array(*map(F.lit, STATUSES)), F.col(status))
    worst = F.max(F.when(known, F.struct(rank.alias("r"), F.col(status).alias("s"))))["s"]
    return rows.groupBy(*group).agg(*[F.count_if(of == s).alias(f"{s}_count") for s in STATUSES], F.coalesce(worst, F.lit("not_applicable")).alias("overall"))


def timeline(*parts: DataFrame, order: list[str]) -> DataFrame:
    """Timed rows of several kinds in one table, columns that a kind lacks left null."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out.orderBy(*order)


def unique_ids(items: DataFrame, id_col: str, source: str, order: list[str]) -> DataFrame:
    """Later items of an id become source-<source>-<id>, further ones of that name -2, -3 and so on; analysis_id keeps the first id."""
    later = F.row_number().over(Window.partitionBy(id_col).orderBy(source, *order)) > 1
    base = F.when(later, F.concat(F.lit("source-"), F.col(source).cast("string"), F.lit("-"), F.col(id_col))).otherwise(F.col(id_col))
    named = items.withColumn("_base", base).withColumn("_k", F.row_number().over(Window.partitionBy("_base").orderBy(source, *order)))
    merged = F.when(F.col("_k") > 1, F.concat("_base", F.lit("-"), F.col("_k").cast("string"))).otherwise(F.col("_base"))
    return named.withColumn("merged_id", merged).withColumn("analysis_id", F.when(F.col("merged_id") != F.col(id_col), F.col(id_col))).drop("_base", "_k")


def sequence_similarity(rows: DataFrame, group: list[str], a: str, b: str) -> DataFrame:
    """(correlation + 1) / 2 of two series, 0 where it is undefined."""
    return rows.groupBy(*group).agg(F.coalesce(F.nanvl((F.corr(a, b) + 1) / 2, F.lit(0.0)), F.lit(0.0)).alias("similarity"))


def movement(dx: Column, dy: Column, scale_change: Column, rotation: Column) -> Column:
    """Name of a global motion from its normalised shift, change of scale and rotation in degrees."""
    shift = F.sqrt(dx * dx + dy * dy)
    return (
        F.when((F.abs(scale_change) >= 0.012) & (scale_change > 0), "push_or_zoom_in")
        .when(F.abs(scale_change) >= 0.012, "pull_or_zoom_out")
        .when((F.abs(rotation) >= 0.8) & (rotation > 0), "roll_clockwise")
        .when(F.abs(rotation) >= 0.8, "roll_counterclockwise")
        .when((shift < 0.0025) & (F.abs(scale_change) < 0.004) & (F.abs(rotation) < 0.25), "static_or_stabilized")
        .when((F.abs(dx) >= F.abs(dy)) & (dx > 0), "pan_left_likely")
        .when(F.abs(dx) >= F.abs(dy), "pan_right_likely")
        .when(dy > 0, "tilt_up_likely")
        .otherwise("tilt_down_likely")
    )


def motion_confidence(inliers: Column, tracks: Column, residual: Column) -> Column:
    share = F.least(F.lit(1.0), inliers / F.greatest(F.lit(1), tracks))
    return F.when(residual > 0.01, share * 0.7).otherwise(share)


def clock(seconds: Column) -> Column:
    """HH:MM:SS.mmm"""
    ms = F.round(seconds * 1000).cast("bigint")
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def transcript(segments: DataFrame, group: str) -> DataFrame:
    """`[start-end] text` lines of each group in order of time."""
    line = F.concat(F.lit("["), clock(F.col("start")), F.lit("-"), clock(F.col("end")), F.lit("] "), F.col("text"))
    lines = segments.select(group, F.struct("start", "end", line.alias("line")).alias("x"))
    return lines.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("transcript"))
