import io
import math
import struct
import wave
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidex.operators import media
from evidex.sources import files, html
from evidex.streaming import incremental


def office_bytes(kind):
    w, a = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"', 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        if kind == "docx":
            cell = "<w:tc><w:p><w:r><w:t>{}</w:t></w:r></w:p></w:tc>"
            z.writestr("word/document.xml", f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:r><w:t>Body</w:t></w:r></w:p><w:tbl><w:tr>{cell.format("x")}{cell.format("y")}</w:tr></w:tbl></w:body></w:document>')
        else:
            z.writestr("ppt/slides/slide1.xml", f"<p {a}><a:p><a:t>Title</a:t></a:p><a:p><a:t>line</a:t></a:p></p>")
    return out.getvalue()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("files")
    (root / "sub").mkdir()
    (root / ".hidden").mkdir()
    (root / "a.md").write_bytes("# One\r\ntext\n## Two \n".encode())
    (root / "sub" / "b.TXT").write_bytes("汉字".encode("gb18030"))
    (root / "c.srt").write_text("1\n00:00:01,500 --> 00:00:02,000\n<i>Hello</i>\nyou\n\n2\n00:00:03,000 --> 00:00:04,000\n\n")
    (root / "d.html").write_text("<h1>Head</h1><script>x</script><p>Body &amp; more</p>")
    (root / "e.docx").write_bytes(office_bytes("docx"))
    (root / "f.pptx").write_bytes(office_bytes("pptx"))
    (root / "broken.docx").write_bytes(b"no zip")
    (root / ".hidden" / "g.md").write_text("x")
    (root / "h.bin").write_bytes(b"\0")
    return str(root)


def test_documents_of_all_formats(spark, folder):
    got = {r.path.rsplit("/", 1)[1]: r for r in files.documents(spark, folder).collect()}
    assert set(got) == {"a.md", "b.TXT", "c.srt", "d.html", "e.docx", "f.pptx", "broken.docx"}
    assert got["a.md"].text == "# One\ntext\n## Two \n" and [(o.level, o.title) for o in got["a.md"].outline] == [(1, "One"), (2, "Two")]
    assert got["b.TXT"].text == "汉字" and got["c.srt"].text == "Hello\nyou" and got["d.html"].text == "Head\nBody & more"
    assert got["e.docx"].text == "Top\n\nBody\n\nx\ty" and got["f.pptx"].text == "[Slide 1]\nTitle\nline" and got["broken.docx"].text == ""


def test_listing_does_not_read_content(spark, folder):
    plan = files.find_files(spark, folder, ["document"]).select("path", "length")._jdf.queryExecution().optimizedPlan().toString()
    assert "content" not in plan.split("Relation")[0]


@pytest.mark.parametrize("data,text", [(b"\xff\xfea\x00", "a"), ("é".encode(), "é"), ("é".encode("cp1252"), "é"), (b"\xef\xbb\xbfx", "x"), ("汉字".encode("gb18030"), "汉字"), (None, "")])
def test_decoding(data, text):
    assert files.decode_bytes(data) == text


def test_cues(spark):
    text = "WEBVTT\n\n1\n00:00:01.500 --> 01:00:02.000\n<b>Hi</b>\n you\n\n00:05.000 --> 00:06.000\n{\\an8}x\n\nnote"
    got = files.cues(spark.createDataFrame([("k", text)], "k string, text string"), "k").orderBy("position").collect()
    assert [(r.start, r.end, r.text) for r in got] == [(1.5, 3602.0, "Hi you"), (5.0, 6.0, "x")]


def test_html_edges(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "<h2><b>A</b> b</h2><h3> </h3><!-- <h1>no</h1> -->")], "page_id int, html string")
    assert [r[0] for r in df.select(html.text("html")).collect()][:2] == ["", ""]
    assert [(r.page_id, r.level, r.title) for r in html.outline(df.where("page_id = 3"), "page_id", "html").collect()][0] == (3, 2, "A b")


def tone(seconds=1.0, rate=16000, hertz=220):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(b"".join(struct.pack("<h", int(12000 * math.sin(2 * math.pi * hertz * i / rate))) for i in range(int(seconds * rate))))
    return out.getvalue()


def test_sound(spark):
    df = spark.createDataFrame([("a.wav", bytearray(tone())), ("b.wav", bytearray(b"none"))], "path string, content binary")
    r = media.acoustic_summary(media.acoustic_frames(df)).collect()
    assert len(r) == 1 and abs(r[0].pitch_median - 220) < 6 and r[0].quiet_share == 0 and -12 < r[0].level_mean < -8


def test_image(spark):
    x = np.zeros((180, 320, 3), np.uint8)
    x[40:120, 60:200] = (250, 10, 10)
    df = spark.createDataFrame([(1, 320, 180, bytearray(x.tobytes()))], "id int, width int, height int, pixels binary")
    r = media.image_metrics(df).first()
    assert 0 < r.brightness < 0.5 and r.warm_balance > 0 and r.palette[0].colour == "#000000" and abs(sum(p.share for p in r.palette) - 1) < 1e-9
    o = df.select(media.orientation(F.col("width"), F.col("height")), media.polygon_area(F.expr("array(named_struct('x', 0.0D, 'y', 0.0D), named_struct('x', 4.0D, 'y', 0.0D), named_struct('x', 4.0D, 'y', 3.0D))"))).first()
    assert tuple(o) == ("landscape", 6.0)


def test_shift():
    a = np.random.default_rng(1).normal(size=(240, 320))
    dx, dy = media.shift_of(a, np.roll(a, -8, axis=1))
    assert abs(dx - 8 / 320) < 1e-9 and dy == 0


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = incremental.windowed_counts(incremental.files(spark, str(tmp_path / "in"), events.schema))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("counted").start()
    query.processAllAvailable()
    query.stop()
    got = {(r.start, r.event_type, r.n) for r in spark.table("counted").collect()}
    want = {(r.w.start, r.event_type, r.n) for r in events.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).collect()}
    assert got == want


def test_index_refresh_replaces_a_repeated_batch(spark, tmp_path):
    write = incremental.index_writer(str(tmp_path / "index"))
    batch = spark.createDataFrame([(1, "概览", "alpha beta alpha")], "doc_id int, field string, content string")
    write(batch, 0)
    write(batch, 0)
    assert sorted((r.token, r.tf) for r in spark.read.parquet(str(tmp_path / "index")).collect()) == [("alpha", 2), ("beta", 1)]
