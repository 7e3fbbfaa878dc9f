"""Status rules: what the stages of an analysis of each medium come to.

A stage is (status, host_review_required); the functions give maps of stages, which
evidence.stage_rollup turns into the item's status and the list to review.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidex.operators.timeline import STATUSES

TOO_SHORT = 0.06  # seconds up to which a scene can't be sampled


def stage(status: Column | str, review: Column | bool = False) -> Column:
    status = F.lit(status) if isinstance(status, str) else status
    return F.struct(status.alias("status"), (F.lit(review) if isinstance(review, bool) else F.coalesce(review, F.lit(False))).alias("host_review_required"))


def stages(**of: Column) -> Column:
    return F.create_map(*[x for name, s in of.items() for x in (F.lit(name), s)])


def document_stages(has_text: Column, low_text_pages: Column, unresolved_pages: Column, rendered_pages: Column) -> Column:
    """Text extraction, and for a document with pages of little text, what became of them."""
    scanned = F.when(F.coalesce(low_text_pages, F.lit(0)) == 0, "not_applicable").when(unresolved_pages == 0, "complete").otherwise("partial")
    return stages(
        text_extraction=stage(F.when(has_text, "complete").otherwise("partial"), ~has_text),
        scanned_pages=stage(scanned, (F.coalesce(low_text_pages, F.lit(0)) > 0) & (unresolved_pages > 0) & (rendered_pages > 0)),
    )


def image_stages(exact_metrics: Column, ocr_wanted: Column, ocr_done: Column) -> Column:
    ocr = F.when(ocr_done, "complete").when(ocr_wanted, "partial").otherwise("not_applicable")
    return stages(metrics=stage(F.when(exact_metrics, "complete").otherwise("degraded")), ocr=stage(ocr, ocr_wanted & ~ocr_done))


def audio_stages(acoustic: Column, transcribe: Column, transcribed: Column) -> Column:
    """acoustic: status of the sound's analysis."""
    spoken = F.when(~transcribe, "not_applicable").when(transcribed, "complete").otherwise("partial")
    return stages(acoustic=stage(acoustic, acoustic == "partial"), transcription=stage(spoken, transcribe & ~transcribed))


def video_required(has_sound: Column, has_subtitles: Column, ocr_wanted: Column, sound_wanted: Column) -> Column:
    """Names of the stages that a video's status depends on."""
    some = lambda ok, name: F.when(F.coalesce(ok, F.lit(False)), F.lit(name))
    always = [F.lit(n) for n in ("probe", "scenes", "keyframes", "motion_analysis")]
    return F.array_compact(F.array(*always, some(has_sound | has_subtitles, "transcript"), some(ocr_wanted, "ocr"), some(has_sound & sound_wanted, "audio_analysis")))


def worst(found: Column, required: Column | None = None) -> Column:
    """The most severe status of the stages in a map (of those named); none: not_applicable."""
    rank = F.array(*map(F.lit, STATUSES))
    names = F.map_keys(found) if required is None else required
    places = F.transform(names, lambda n: F.array_position(rank, F.coalesce(F.try_element_at(found, n)["status"], F.lit("failed"))))
    known = F.transform(places, lambda p: F.when(p > 0, p).otherwise(F.array_position(rank, F.lit("failed"))))
    return F.element_at(rank, F.coalesce(F.array_max(known), F.lit(1)).cast("int"))


def to_review(found: Column) -> Column:
    return F.array_sort(F.map_keys(F.map_filter(found, lambda _, s: s["host_review_required"])))


def scene_status(duration: Column) -> Column:
    return F.when(duration <= TOO_SHORT, "too_short").otherwise("usable")


def resumed(items: DataFrame, earlier: DataFrame, key: str = "id") -> DataFrame:
    """items with the status an earlier run left (id, status): unknown ones and unreadable analyses failed, one without status is complete."""
    known = earlier.select(key, F.when(F.col("status").isNull(), "complete").when(F.col("status").isin(STATUSES), F.col("status")).otherwise("failed").alias("status"))
    return items.join(known, key, "left").withColumn("status", F.coalesce("status", F.lit("failed")))
