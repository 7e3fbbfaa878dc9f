"""File scans: listings by extension, decoding, subtitles, office documents.

Listings read no content unless it is selected: the binaryFile source lists path,
length and time, and Spark prunes the content column.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidex.functions import text as T
from evidex.sources import html

# File kinds by ending.
KINDS = {
    "video": [".mp4", ".mov", ".mkv", ".avi", ".webm", ".m4v", ".flv", ".wmv", ".mpeg", ".mpg", ".ts", ".mts", ".3gp"],
    "audio": [".mp3", ".wav", ".m4a", ".aac", ".flac", ".ogg", ".opus", ".wma", ".aiff", ".aif", ".amr", ".mka"],
    "image": [".jpg", ".jpeg", ".png", ".webp", ".bmp", ".gif", ".tif", ".tiff", ".heic", ".heif", ".avif"],
    "document": [".txt", ".md", ".markdown", ".rst", ".html", ".htm", ".pdf", ".docx", ".pptx", ".srt", ".vtt", ".ass", ".csv", ".json", ".yaml", ".yml"],
}
TIME = r"(?:([0-9]+):)?([0-9]{1,2}):([0-9]{2})[,.]([0-9]{3})"
TIMING = rf"{TIME}[ \t]*-->[ \t]*{TIME}"
TAG = r"<[^>]+>|\{\\[^}]+\}"


def find_files(spark: SparkSession, folder: str, kinds: list[str] | None = None, recursive: bool = True) -> DataFrame:
    """path, relative_path, modificationTime, length and content of files of the kinds, by ending; names or folders that start with a dot are left out."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    relative = F.regexp_replace("path", "^.*?" + re.escape(re.sub(r"^\w+:/*", "", folder.rstrip("/")).lstrip("/")) + "/", "")
    found = rows.withColumn("relative_path", relative).where(~F.col("relative_path").rlike(r"(?:^|/)\."))
    if kinds:
        endings = [e for k in kinds for e in KINDS[k]]
        found = found.where(F.regexp_extract(F.lower("path"), r"(\.[^./]+)$", 1).isin(endings))
    return found


def ordered(files: DataFrame, path: str = "relative_path") -> DataFrame:
    """files by the lower case of their path, then the path."""
    return files.orderBy(F.lower(path), path)


# How many sources of each kind a run takes.
MOST_SOURCES = {"document": 500, "image": 1000, "video": 100, "audio": 500, "repository": 20_000, "capture": 2000}


def within(files: DataFrame, kind: str, most: int | None = None) -> DataFrame:
    """files, or an error when there are more than a run of the kind takes; an optional guard, as nothing here needs the bound."""
    most = MOST_SOURCES[kind] if most is None else most
    if files.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} sources of kind {kind}")
    return files


# Names of the files that a library's index covers by default.
INDEX_PATTERNS = ["*-收录.md", "*-蒸馏.md", "品牌视觉.md", "视觉蒸馏.md", "UI交互.md", "方法蒸馏.md", "技术方案.md"]


def index_sources(files: DataFrame, patterns: list[str] | None = None, skip: tuple[str, ...] = (), path: str = "relative_path") -> DataFrame:
    """Files whose name matches one of the patterns (* and ?), each once, without those in a folder to skip."""
    name = F.substring_index(path, "/", -1)
    some = F.lit(False)
    for pattern in INDEX_PATTERNS if patterns is None else patterns:
        some = some | name.rlike("^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in pattern) + "$")
    folders = F.slice(F.split(F.col(path), "/"), 1, F.greatest(F.lit(0), F.size(F.split(F.col(path), "/")) - 1))
    return files.where(some & ~F.arrays_overlap(folders, F.array(*map(F.lit, skip)).cast("array<string>"))).dropDuplicates([path])


INDEX_VERSION = 2


def load_index(spark: SparkSession, folder: str, schema: str, version: int = INDEX_VERSION) -> DataFrame:
    """An inverted table written with its schema_version; one of another version is refused, never read as if it were this one."""
    rows = spark.read.schema(f"schema_version int, {schema}").parquet(folder)
    other = rows.where(~F.col("schema_version").eqNullSafe(F.lit(version))).limit(1).count()
    if other:
        raise ValueError("unsupported index version; build it again")
    return rows.drop("schema_version")


def load_json(spark: SparkSession, folder: str, schema: str, pattern: str = "*.json") -> DataFrame:
    """path, the schema's fields and status of every JSON document under a folder; a byte order mark is left out, a broken file fails alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    text = F.regexp_replace(F.col("content").cast("string"), "^\ufeff", "")
    parsed = files.select("path", F.from_json(text, f"{schema}, _broken string", {"columnNameOfCorruptRecord": "_broken", "mode": "PERMISSIVE"}).alias("d"))
    return parsed.select("path", "d.*").withColumn("status", F.when(F.col("_broken").isNull(), "complete").otherwise("failed")).drop("_broken")


def markdown_files(spark: SparkSession, folder: str) -> DataFrame:
    """path and text of all Markdown files under a folder."""
    return decoded(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(folder)).select("path", "text")


def sidecars(videos: DataFrame, files: DataFrame, path: str = "path") -> DataFrame:
    """video, subtitles and place (from 1): subtitle files that lie beside a video under its name."""
    endings = F.regexp_extract(F.lower(path), r"(\.[^./]+)$", 1)
    found = files.where(endings.isin(".srt", ".vtt", ".ass")).select(F.col(path).alias("subtitles"), T.stem(F.col(path)).alias("_stem"))
    both = videos.select(F.col(path).alias("video"), T.stem(F.col(path)).alias("_stem")).join(found, "_stem")
    return both.select("video", "subtitles", F.row_number().over(Window.partitionBy("video").orderBy("subtitles")).alias("place"))


#: Kinds whose content needs a library or a program that may be absent, and what then is to be done.
OPTIONAL = {".pdf": "pdf", **dict.fromkeys(KINDS["video"], "media"), **dict.fromkeys([e for e in KINDS["audio"] if e != ".wav"], "media")}


def unread(files: DataFrame, engines: tuple[str, ...] = (), path: str = "path") -> DataFrame:
    """path, engine and status of files that need an engine which isn't at hand: none vanishes without a row."""
    of = F.create_map(*[F.lit(x) for kv in OPTIONAL.items() for x in kv])
    engine = F.try_element_at(of, F.regexp_extract(F.lower(path), r"(\.[^./]+)$", 1))
    return files.select(path, engine.alias("engine")).where(F.col("engine").isNotNull() & ~F.col("engine").isin(*engines, "")).withColumn("status", F.lit("not_applicable"))


def low_text_pages(pages: DataFrame, text: str = "text", least: int = 30) -> DataFrame:
    """Pages with less than `least` characters, blanks at the ends not counted: they need to be looked at as pictures."""
    return pages.where(F.length(T.strip(F.coalesce(F.col(text), F.lit("")))) < least)


def source_id(relative_path: Column, content: Column) -> Column:
    """Slug of the name and ten digits of a hash over path and whole content, so equal files in two folders stay apart."""
    stem = F.regexp_replace(F.substring_index(relative_path, "/", -1), r"\.[^.]*$", "")
    return F.concat(T.slug(stem), F.lit("-"), F.substring(F.sha2(F.concat(relative_path.cast("binary"), content), 256), 1, 10))


def decode_bytes(data: bytes | None) -> str:
    """UTF-8, UTF-16 with a byte order mark, GB 18030, else Windows-1252, undecodable bytes replaced."""
    data = data or b""
    codes = ["utf-16"] if data[:2] in (b"\xff\xfe", b"\xfe\xff") else []
    for code in [*codes, "utf-8-sig", "gb18030", "cp1252"]:
        try:
            return data.decode(code)
        except UnicodeDecodeError:
            continue
    return data.decode("utf-8", "replace")


def decoded(files: DataFrame, content: str = "content", to: str = "text") -> DataFrame:
    """files with the text of their bytes: Arrow batches, one column in and one out."""

    @F.pandas_udf("string")
    def text_of(data: pd.Series) -> pd.Series:
        return data.map(decode_bytes)

    return files.withColumn(to, text_of(content))


def small_texts(files: DataFrame, limit: int = 200_000) -> DataFrame:
    """Files that are worth reading as text: not longer than the limit, no zero byte in the first 4 kB."""
    head = F.regexp_replace(F.hex(F.substring("content", 1, 4096)), "(..)", "$1 ")
    return files.where((F.length("content") <= limit) & (F.locate("00", head) == 0))


def plain(text: Column) -> Column:
    return F.replace(text, F.lit("\r\n"), F.lit("\n"))


def outline(text: Column, most: int = 300) -> Column:
    """Markdown headings: array of (level, title)."""
    found = F.regexp_extract_all(plain(text), F.lit(r"(?m)^[ \t]{0,3}#{1,6}[ \t]+[^\n]*?[^ \t\n][ \t]*$"), F.lit(0))
    return F.slice(F.transform(found, lambda h: F.struct(F.length(F.regexp_extract(h, "#+", 0)).alias("level"), T.strip(F.regexp_replace(h, r"^[ \t]*#+", "")).alias("title"))), 1, most)


def seconds(h: Column, m: Column, s: Column, ms: Column) -> Column:
    n = lambda x: F.coalesce(F.expr("try_cast(0 as double)") if x is None else x.try_cast("double"), F.lit(0.0))
    return F.round(n(h) * 3600 + n(m) * 60 + n(s) + n(ms) / 1000, 3)


def cues(files: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, position, start, end, text of subtitle cues: a timing line and the lines up to the next blank one; tags go, empty cues too."""
    blocks = F.split(plain(F.col(text)), r"\n[ \t]*\n")
    rows = files.select(key, F.posexplode(blocks).alias("position", "b")).where(F.col("b").rlike(TIMING))
    part = lambda i: F.regexp_extract("b", TIMING, i)
    body = F.regexp_replace(F.regexp_replace("b", rf"(?s)^.*?{TIMING}[^\n]*\n?", ""), TAG, "")
    cut = rows.select(key, "position", seconds(*map(part, (1, 2, 3, 4))).alias("start"), seconds(*map(part, (5, 6, 7, 8))).alias("end"), T.squeezed(body).alias("text"))
    return cut.where("text <> ''")


ASS_LINE = r"(?m)^Dialogue:[ \t]*[^,\n]*,([0-9]+):([0-9]{2}):([0-9]{2})\.([0-9]{2}),([0-9]+):([0-9]{2}):([0-9]{2})\.([0-9]{2}),(?:[^,\n]*,){6}([^\n]*)$"


def ass_cues(files: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, position, start, end, text of the dialogue lines of .ass subtitles; style overrides go, line break marks are blanks."""
    rows = files.select(key, F.posexplode(F.regexp_extract_all(plain(F.col(text)), F.lit(ASS_LINE), F.lit(0))).alias("position", "l"))
    part = lambda i: F.regexp_extract("l", ASS_LINE, i)
    body = T.squeezed(F.regexp_replace(F.regexp_replace(part(9), r"\{[^}]*\}", ""), r"\\[Nnh]", " "))
    at = lambda i: seconds(part(i), part(i + 1), part(i + 2), F.concat(part(i + 3), F.lit("0")))
    return rows.select(key, "position", at(1).alias("start"), at(5).alias("end"), body.alias("text")).where("text <> ''")


def subtitle_text(text: Column) -> Column:
    """The spoken lines of a subtitle file: no numbers, timings or tags."""
    kept = F.filter(T.lines(text), lambda x: ~x.rlike(r"^[0-9]+$") & ~x.rlike(rf"^{TIMING}"))
    return F.array_join(F.filter(F.transform(kept, lambda x: T.strip(F.regexp_replace(x, TAG, ""))), lambda x: x != ""), "\n")


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"


def docx_text(data: bytes) -> tuple[str, list[tuple[int, str]]]:
    """Paragraphs and tables (cells by tab) in order, and (level, title) of headings."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    words = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t")).strip()
    out, heads = [], []
    for e in body if body is not None else []:
        if e.tag == f"{_W}p":
            text, style = words(e), e.find(f"{_W}pPr/{_W}pStyle")
            level = re.search(r"(?i)heading ?([1-9])", style.get(f"{_W}val", "") if style is not None else "")
            if text:
                out.append(text)
                if level:
                    heads.append((int(level[1]), text))
        elif e.tag == f"{_W}tbl":
            out += ["\t".join(words(c) for c in r.iter(f"{_W}tc")) for r in e.iter(f"{_W}tr")]
    return "\n\n".join(out), heads[:300]


def pptx_text(data: bytes) -> tuple[str, list[tuple[int, str]]]:
    """Slides' texts in order; a slide's first line is its title."""
    out, heads = [], []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
        for number, name in names:
            lines = ["".join(t.text or "" for t in p.iter(f"{_A}t")).strip() for p in ElementTree.fromstring(z.read(name)).iter(f"{_A}p")]
            lines = [x for x in lines if x]
            if lines:
                heads.append((1, lines[0]))
                out.append(f"[Slide {number}]\n" + "\n".join(lines))
    return "\n\n".join(out), heads[:300]


def office(files: DataFrame, key: str = "path") -> DataFrame:
    """key, text, outline and status of .docx and .pptx files; a broken one fails alone."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, data in zip(batch.iloc[:, 0], batch.iloc[:, 1], strict=True):
                try:
                    text, heads = (docx_text if path.lower().endswith(".docx") else pptx_text)(bytes(data))
                    rows.append((path, text, [{"level": a, "title": b} for a, b in heads], "complete"))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    rows.append((path, "", [], "failed"))
            yield pd.DataFrame(rows, columns=[key, "text", "outline", "status"])

    chosen = files.where(F.lower(key).rlike(r"\.(?:docx|pptx)$")).select(key, "content")
    return chosen.mapInPandas(read, f"{key} string, text string, outline array<struct<level:int,title:string>>, status string")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """path, kind, text, outline and status of all documents in a folder: one scan a format, put together by name.

    A file without text is partial, a broken one failed; .pdf files need a library that isn't here and are not_applicable.
    """
    files = find_files(spark, folder, ["document"])
    ending = F.regexp_extract(F.lower("path"), r"(\.[^./]+)$", 1)
    text = decoded(files.where(~ending.isin(".docx", ".pptx", ".pdf")).withColumn("kind", ending)).drop("content")
    as_web = F.col("kind").isin(".html", ".htm")
    as_cues = F.col("kind").isin(".srt", ".vtt", ".ass")
    spoken = F.regexp_extract_all(plain(F.col("text")), F.lit(ASS_LINE), F.lit(9))
    dialogue = F.array_join(F.transform(spoken, lambda x: T.squeezed(F.regexp_replace(F.regexp_replace(x, r"\{[^}]*\}", ""), r"\\[Nnh]", " "))), "\n")
    body = F.when(as_web, html.text("text")).when(F.col("kind") == ".ass", dialogue).when(as_cues, subtitle_text(F.col("text"))).otherwise(plain(F.col("text")))
    plain_rows = text.select("path", "kind", body.alias("text"), F.when(~as_web & ~as_cues, outline(F.col("text"))).alias("outline"))
    plain_rows = plain_rows.withColumn("status", F.when(T.strip("text") == "", "partial").otherwise("complete"))
    rows = plain_rows.unionByName(office(files).select("path", ending.alias("kind"), "text", "outline", "status"))
    none = unread(files).select("path", ending.alias("kind"), F.lit("").alias("text"), F.lit(None).cast("array<struct<level:int,title:string>>").alias("outline"), "status")
    return rows.unionByName(none)
