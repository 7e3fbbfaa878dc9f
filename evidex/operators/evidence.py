"""Reviewed cards: long tables of their patterns, support by source, tiers, templates, referential gates.

A card is a row (source_id, source_type, review_status, patterns: array of structs);
patterns() makes one row of each pattern, and everything below is an aggregate or an
anti-join over such rows.  A gate passes when its violation table is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidex.functions import text as T

# What a review of each kind of analysis looks at.
REVIEW_DIMENSIONS = {
    "document-analysis": ["structure and information order", "argument or teaching moves", "voice and audience distance", "sentence and paragraph rhythm", "rhetorical actions", "topic-dependent versus stable traits"],
    "image-analysis": ["subject and hierarchy", "composition", "lighting", "color roles", "typography and graphics", "material and finish", "stable visual rules versus content variables"],
    "video-analysis": ["narrative beats", "shot grammar", "camera and subject motion", "composition and continuity", "editing and transitions", "speech music text synchronization", "stable rules versus one-off choices"],
    "audio-analysis": ["content structure", "speaker and audience relation", "pace pauses and emphasis", "prosody and emotion", "music and sound layers", "stable audio rules versus content variables"],
    "repository-analysis": ["user-visible purpose", "architecture and module boundaries", "data and control flow", "technical decisions and tradeoffs", "failure handling", "transferable methods versus project-specific facts"],
    "website-analysis": ["information architecture", "primary user path", "interaction states and feedback", "visual system", "data and service behavior", "transferable product rules versus brand-specific assets"],
    "app-analysis": ["onboarding permissions and navigation", "primary task flows", "interaction states", "failure and recovery", "platform conventions", "transferable product rules"],
    "ui-analysis": ["layout and information hierarchy", "component states", "interaction and motion", "responsive and accessible behavior", "content relationships", "transferable UI rules"],
    "brand-analysis": ["identity logic", "color typography and imagery roles", "cross-format consistency", "content variables", "protected assets", "transferable visual rules"],
    "course-analysis": ["learning objectives", "concept dependencies", "teaching sequence", "examples and exercises", "feedback and assessment", "transfer boundaries"],
    "mixed-analysis": ["cross-source relationships", "shared mechanisms", "contradictions", "sequence and dependencies", "content variables", "transferable system-level rules"],
}
# Media that are evaluated like another one.
MEDIUM_ALIASES = {"article": "writing", "book": "document", "visual": "image", "podcast": "audio", "web": "website", "interaction": "ui", "project": "repository"}


def patterns(cards: DataFrame) -> DataFrame:
    """source_id, position and the pattern's fields of completed cards."""
    return cards.where("review_status = 'complete'").select("source_id", F.posexplode("patterns").alias("position", "p")).select("source_id", "position", "p.*")


def support(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """By key of the transferable patterns: sources, their share of all, mean confidence and the first statement.

    Distinct sources are counted without collecting them.
    """
    some = rows.where(F.coalesce("transferable", F.lit(True)))
    n = sources.select("source_id").distinct().agg(F.greatest(F.lit(1), F.count("*")).alias("n"))
    counts = some.groupBy("key").agg(F.count_distinct("source_id").alias("support_count"), F.round(F.avg("confidence"), 4).alias("mean_confidence"), F.min_by("statement", F.struct("source_id", "position")).alias("statement"))
    return counts.crossJoin(F.broadcast(n)).withColumn("support_share", F.round(F.col("support_count") / F.col("n"), 4)).drop("n")


#: A pattern's fields whose values are listed by key.
LISTED = ["statement", "mechanism", "trigger", "boundary"]


def listed(rows: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """key, field, place (from 0), value and source_id: the values of each field, the first of those equal but for case and white space, in order.

    A key's statement is the one at place 0, the others are its variants.  Long rows:
    a key that all sources share makes no row larger.
    """
    some = rows.where(F.coalesce("transferable", F.lit(True)))
    each = some.select("key", "source_id", "position", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields or LISTED])).alias("x")).select("key", "source_id", "position", "x.*")
    first = first_seen(each, ["key", "field"], "value", ["source_id", "position"])
    place = F.row_number().over(Window.partitionBy("key", "field").orderBy("source_id", "position")) - 1
    return first.select("key", "field", place.alias("place"), "value", "source_id")


def cited(rows: DataFrame) -> DataFrame:
    """key, source_id and the fields of every piece of evidence of the transferable patterns."""
    some = rows.where(F.coalesce("transferable", F.lit(True)))
    return some.select("key", "source_id", F.explode("evidence").alias("e")).select("key", "source_id", "e.*")


def tiers(supported: DataFrame, minimum: int = 2, share: float = 0.5) -> DataFrame:
    stable = (F.col("support_count") >= max(2, minimum)) & (F.col("support_share") >= min(1.0, max(0.0, share)))
    return supported.withColumn("tier", F.when(stable, "stable").when(F.col("support_count") >= 2, "conditional").otherwise("observation"))


def first_seen(rows: DataFrame, group: list[str], value: str, order: list[str]) -> DataFrame:
    """Of values equal but for case and white space the first one; blank ones go."""
    keyed = rows.withColumn("_k", F.lower(T.squeezed(value))).where("_k <> ''")
    w = Window.partitionBy(*group, "_k").orderBy(*order)
    return keyed.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_k").withColumn(value, T.squeezed(value))


def missing(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of a that b lacks."""
    return a.select(*keys).distinct().join(b.select(*keys).distinct(), keys, "left_anti")


def unbacked(cited: DataFrame, cards: DataFrame, keys: list[str]) -> DataFrame:
    """What a profile cites and no completed card holds."""
    return missing(cited, cards, keys)


def outside(cited: DataFrame, roots: DataFrame, path: str = "path", root: str = "root") -> DataFrame:
    """Cited paths that lie in none of the declared folders.

    Every folder a path is in is listed by its parts and joined by equality, so
    neither side is broadcast and no pair is compared that can't match.
    """
    parts = F.split(F.regexp_replace(path, "/+$", ""), "/")
    above = cited.select(path, F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("_in"))
    declared = roots.select(F.regexp_replace(root, "/+$", "").alias("_in")).distinct()
    inside = above.join(declared, "_in").select(path).distinct()
    return cited.select(path).distinct().join(inside, path, "left_anti")


def review_tasks(items: DataFrame, kind: str = "kind") -> DataFrame:
    """items, each with the dimensions of its kind's review; unknown kinds are reviewed as mixed ones."""
    of = F.create_map(*[x for k, ds in REVIEW_DIMENSIONS.items() for x in (F.lit(k), F.array(*map(F.lit, ds)))])
    return items.select("*", F.posexplode(F.coalesce(F.try_element_at(of, F.col(kind)), F.try_element_at(of, F.lit("mixed-analysis")))).alias("position", "dimension"))


def medium(x: Column) -> Column:
    low = F.lower(x)
    return F.coalesce(F.create_map(*[F.lit(y) for p in MEDIUM_ALIASES.items() for y in p])[low], low)


# What a candidate of each medium is evaluated on, and whether it is a hard constraint.
EVALUATION_DIMENSIONS = {
    "writing": [("facts and new-topic coverage", True), ("article structure and reasoning moves", True), ("voice audience distance and emotional movement", False), ("sentence paragraph rhythm and rhetorical actions", False), ("originality and protected-expression boundary", True)],
    "document": [("factual and structural correctness", True), ("method or teaching sequence", True), ("voice and readability", False), ("boundaries examples and counterexamples", True)],
    "video": [("format duration and required assets", True), ("narrative and shot structure", True), ("camera subject motion and continuity", True), ("editing text and sound synchronization", False), ("technical artifacts and protected assets", True)],
    "audio": [("duration content and required assets", True), ("section and speech structure", True), ("pace pauses emphasis and prosody", False), ("sound layers transitions and dynamics", False)],
    "image": [("format content and required objects", True), ("composition and information hierarchy", True), ("color lighting material and finish", False), ("typography readability and asset boundary", True)],
    "brand": [("brand objective and required content", True), ("composition and identity system", True), ("color typography and imagery roles", False), ("protected asset and adaptation boundary", True)],
    "website": [("primary task completion", True), ("states feedback and recovery", True), ("layout interaction and motion", False), ("responsive accessibility and performance", True)],
    "app": [("primary task completion", True), ("navigation permissions and state recovery", True), ("platform interaction and visual system", False), ("offline accessibility and failure handling", True)],
    "ui": [("task path and state coverage", True), ("layout hierarchy and component relationships", True), ("interaction motion and feedback", False), ("responsive and accessible behavior", True)],
    "repository": [("requested behavior and outputs", True), ("architecture data and control flow", True), ("failure handling tests and operability", True), ("method transfer and project-specific boundary", False)],
    "course": [("learning objective and factual correctness", True), ("concept dependency and teaching sequence", True), ("examples exercises feedback and assessment", False), ("prerequisites and transfer boundary", True)],
    "mixed": [("new objective and required outputs", True), ("cross-source mechanism consistency", True), ("modality-specific quality", False), ("dependencies contradictions and boundaries", True)],
}


def evaluation_template(profiles: DataFrame, medium_col: str = "medium") -> DataFrame:
    """profiles, each with position, name and hard_constraint of its medium's dimensions; aliases are followed, unknown media are mixed ones."""
    table = F.create_map(*[x for m, ds in EVALUATION_DIMENSIONS.items() for x in (F.lit(m), F.array(*[F.struct(F.lit(n).alias("name"), F.lit(h).alias("hard_constraint")) for n, h in ds]))])
    found = F.coalesce(F.try_element_at(table, medium(F.col(medium_col))), F.try_element_at(table, F.lit("mixed")))
    return profiles.select("*", F.posexplode(found).alias("position", "_d")).select(*profiles.columns, "position", "_d.name", "_d.hard_constraint")


def stage_rollup(stages: Column, required: list[str]) -> tuple[Column, Column]:
    """Worst status of the required stages and the names, sorted, of all that a person must look at.

    stages: map of name to (status, host_review_required); a required stage that is missing counts as failed.
    """
    from evidex.operators.timeline import STATUSES

    rank = F.array(*map(F.lit, STATUSES))
    of = F.transform(F.array(*map(F.lit, required)), lambda s: F.coalesce(F.try_element_at(stages, s)["status"], F.lit("failed")))
    worst = F.element_at(rank, F.greatest(F.lit(1), F.array_max(F.transform(of, lambda s: F.array_position(rank, s))).cast("int")))
    review = F.array_sort(F.map_keys(F.map_filter(stages, lambda _, v: F.coalesce(v["host_review_required"], F.lit(False)))))
    return worst, review
