"""Library: sections of Markdown, an inverted table kept up incrementally, ranked search with excerpts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidex.functions import text as T

# How much a field's hits weigh; other fields weigh DEFAULT_WEIGHT.
FIELD_WEIGHTS = {
    "标题": 8.0, "项目介绍": 4.5, "适合参考的方向": 5.0, "核心功能": 5.0, "技术栈": 4.0, "项目结构": 1.5, "核心流程": 3.5, "数据流": 3.0,
    "外部依赖": 2.5, "UI/交互亮点": 5.5, "值得借鉴": 6.0, "整理重点": 2.0, "缺点": 3.5, "运行方式": 1.0, "概览": 2.0,
}
DEFAULT_WEIGHT, PHRASE_WEIGHT = 2.0, 2.5
# Subjects too general to tell documents apart, and what a subject line starts with.
GENERIC = ["这是", "该项目", "这个项目", "本项目", "网站", "应用", "仓库"]
SUBJECT = r"^(.{2,64}?)[ \t]*(?:是一个|是一款|是面向|是围绕|是用于|是由|是个)"


def sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, position, section, content: what stands before the first `## ` heading is 概览, numbers before a heading are dropped, empty sections too.

    Texts are redacted first.  Sections of one heading are put together in order.
    """
    clean = T.redacted(F.replace(F.coalesce(F.col(text_col), F.lit("")), F.lit("\r\n"), F.lit("\n")))
    parts = F.split(F.concat(F.lit("\n"), clean), r"\n##[ \t]+(?=[^ \t\n])")
    rows = docs.select(id_col, F.posexplode(parts).alias("position", "_p"))
    first = F.col("position") == 0
    head = F.when(first, F.lit("概览")).otherwise(T.strip(F.regexp_replace(T.strip(F.substring_index("_p", "\n", 1)), r"^[0-9]+[.、][ \t]*", "")))
    body = F.when(first, F.regexp_replace("_p", r"(?m)^#[ \t]+[^\n]*$", "")).otherwise(F.when(F.instr("_p", "\n") > 0, F.expr("substring(_p, instr(_p, '\n') + 1)")).otherwise(""))
    named = rows.select(id_col, "position", head.alias("section"), T.strip(body).alias("content")).where("content <> ''")
    joined = named.groupBy(id_col, "section").agg(F.min("position").alias("position"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "content"))), lambda x: x["content"]), "\n").alias("content"))
    return joined.select(id_col, "position", "section", "content")


def title(text: Column | str) -> Column:
    """The first `# ` heading; null without one."""
    found = F.regexp_extract(F.col(text) if isinstance(text, str) else text, r"(?m)^#[ \t]+(.+?)[ \t]*$", 1)
    return F.when(found != "", found)


def subject(introduction: Column) -> Column:
    """What the introduction says it is about, in lower case; empty if that is nothing or too general."""
    lines = F.filter(F.transform(T.paragraphs(introduction), T.squeezed), lambda p: ~p.rlike("^(?:项目地址|GitHub 地址|体验地址)"))
    found = F.transform(lines, lambda p: T.squeezed(F.lower(F.regexp_replace(F.regexp_replace(F.regexp_extract(p, SUBJECT, 1), r"[`*_\[\]()]", ""), r"^[ ：:，,。.]+|[ ：:，,。.]+$", ""))))
    return F.coalesce(F.get(F.filter(found, lambda s: (s != "") & ~s.isin(GENERIC)), F.lit(0)), F.lit(""))


def inverted(fields: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id_col, field, token, tf of rows (id_col, field, content).  Written once, partitioned by token, it serves all searches."""
    tokens = fields.select(id_col, "field", F.explode(T.search_tokens("content")).alias("token"))
    return tokens.groupBy(id_col, "field", "token").agg(F.count("*").alias("tf"))


def delta(old: DataFrame, new: DataFrame, key: str = "path", size: str = "size", time: str = "mtime") -> DataFrame:
    """key and state of every row of either: reused (size and time equal), changed, added or removed."""
    a = old.select(key, F.col(size).alias("_s"), F.col(time).alias("_t"), F.lit(True).alias("_old"))
    b = new.select(key, F.col(size).alias("_s2"), F.col(time).alias("_t2"), F.lit(True).alias("_new"))
    state = F.when(F.col("_new").isNull(), "removed").when(F.col("_old").isNull(), "added").when(F.col("_s").eqNullSafe(F.col("_s2")) & F.col("_t").eqNullSafe(F.col("_t2")), "reused").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, state.alias("state"))


def _weight(field: Column) -> Column:
    pairs = [x for f, w in FIELD_WEIGHTS.items() for x in (F.lit(f), F.lit(w))]
    return F.coalesce(F.create_map(*pairs)[field], F.lit(DEFAULT_WEIGHT))


def field_scores(index: DataFrame, fields: DataFrame, tokens: list[str], phrases: list[str], documents: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id_col, field, score > 0 of the fields that hold a token of the query or a phrase of it.

    Only the query's tokens are read from the inverted table (a pushed-down filter);
    their document counts are a table of as many rows as the query has tokens.
    """
    hits = index.where(F.col("token").isin(tokens))
    df = hits.groupBy("token").agg(F.count_distinct(id_col).alias("df"))
    n = documents.select(id_col).distinct().agg(F.greatest(F.lit(1), F.count("*")).alias("n"))
    scored = hits.join(F.broadcast(df), "token").crossJoin(F.broadcast(n))
    by_token = scored.groupBy(id_col, "field").agg(F.sum(_weight(F.col("field")) * F.log(1 + (F.col("n") + 0.5) / (F.col("df") + 0.5)) * (1 + F.log("tf"))).alias("s"))
    low = F.lower("content")
    found = sum((F.when(F.contains(low, F.lit(p)), 1.0).otherwise(0.0) for p in phrases), F.lit(0.0))
    by_phrase = fields.select(id_col, "field", (found * PHRASE_WEIGHT * _weight(F.col("field"))).alias("s")).where("s > 0")
    both = by_token.unionByName(by_phrase).groupBy(id_col, "field").agg(F.sum("s").alias("score"))
    return both.where("score > 0")


def ranked(scores: DataFrame, identity: DataFrame | None = None, limit: int = 6, id_col: str = "doc_id") -> DataFrame:
    """The best documents by total score, ties by id; of documents of one identity (not empty) the best only; limit 1 to 20."""
    limit = max(1, min(limit, 20))
    total = scores.groupBy(id_col).agg(F.sum("score").alias("score"))
    if identity is not None:
        known = total.join(identity.select(id_col, "identity"), id_col, "left")
        w = Window.partitionBy("identity").orderBy(F.desc("score"), id_col)
        total = known.withColumn("_r", F.row_number().over(w)).where(F.col("identity").isNull() | (F.col("identity") == "") | (F.col("_r") == 1)).drop("_r", "identity")
    return total.orderBy(F.desc("score"), id_col).limit(limit)


def best_sections(scores: DataFrame, most: int = 3, id_col: str = "doc_id") -> DataFrame:
    w = Window.partitionBy(id_col).orderBy(F.desc("score"), F.desc("field"))
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def within_budget(results: DataFrame, order: list, budget: int) -> DataFrame:
    """Leading results whose JSON stays within `budget` characters together; results are few, ranked ones."""
    body = F.length(F.to_json(F.struct(*results.columns)))
    w = Window.orderBy(*order)
    return results.withColumn("_sum", F.sum(body + 2).over(w.rowsBetween(Window.unboundedPreceding, 0)) + 2).where(F.col("_sum") <= budget).drop("_sum")
