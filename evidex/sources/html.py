"""Text and outline of HTML, by expressions that stay in the JVM: no parser, no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Entities that are turned back.
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]
STEPS = [
    (r"(?is)<(?:script|style|noscript|template)\b.*?</(?:script|style|noscript|template)[^>]*>", " "),
    (r"(?s)<!--.*?-->", " "),
    (r"(?i)</(?:p|div|li|tr|h[1-6]|article|section|ul|ol|table|header|footer|nav)>|<br[^>]*>", "\n"),
    (r"<[^>]+>", " "),
]
AFTER = [(r"[ \t\r\f]+", " "), (r" ?\n[ \n]*", "\n"), (r"^[ \n]+|[ \n]+$", "")]
HEADING = r"(?is)<h[1-6][^>]*>.*?</h[1-6]>"


def _flat(x: Column) -> Column:
    for pattern, to in STEPS:
        x = F.regexp_replace(x, pattern, to)
    for entity, to in ENTITIES:
        x = F.replace(x, F.lit(entity), F.lit(to))
    return x


def text(x: Column | str) -> Column:
    """Visible text: block ends become line ends, other tags blanks; blanks collapsed, no empty lines."""
    x = _flat(F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit("")))
    for pattern, to in AFTER:
        x = F.regexp_replace(x, pattern, to)
    return x


def text_sql(x: str) -> str:
    x = f"coalesce({x}, '')"
    for pattern, to in STEPS:
        x = f"regexp_replace({x}, '{pattern}', '{to}', 'g')"
    for entity, to in ENTITIES:
        x = "replace({}, '{}', '{}')".format(x, entity, to.replace("'", "''"))
    for pattern, to in AFTER:
        x = f"regexp_replace({x}, '{pattern}', '{to}', 'g')"
    return x


def outline(pages: DataFrame, id_col: str, html_col: str, most: int = 300) -> DataFrame:
    """id_col, position (from 0), level and title of the first `most` headings that have a title."""
    found = F.transform(F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(HEADING), F.lit(0)), lambda h: F.struct(F.substring(h, 3, 1).cast("int").alias("level"), text(h).alias("title")))
    titled = F.slice(F.filter(found, lambda h: h["title"] != ""), 1, most)
    return pages.select(id_col, F.posexplode(titled).alias("position", "h")).select(id_col, "position", "h.level", "h.title")


OUTLINE_SQL = f"""
WITH h AS (SELECT page_id, list_filter(list_transform(regexp_extract_all(html, '{HEADING}'), lambda h: {{'level': CAST(substring(h, 3, 1) AS INTEGER), 'title': {text_sql('h')}}}), lambda h: h.title <> '')[1:300] AS h FROM pages),
u AS (SELECT page_id, unnest(range(len(h))) AS position, unnest(h) AS h FROM h)
SELECT page_id, CAST(position AS INTEGER) AS position, h.level AS level, h.title AS title FROM u
"""
