"""Scans, images, sinks, streaming and the model stage."""

import struct
import zlib

import pytest
from pyspark.sql import functions as F

from paperloom.sources import pdf, scan, sinks
from paperloom.streaming import ingest, model


def png(colour, pixels, width, height):
    channels = {2: 3, 4: 2, 6: 4}[colour]
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    lines = b"".join(b"\0" + bytes(pixels[y * width * channels : (y + 1) * width * channels]) for y in range(height))
    head = struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def test_alpha_is_put_on_white(spark):
    clear = png(6, [10, 20, 30, 0, 10, 20, 30, 255], 2, 1)
    solid = png(2, [1, 2, 3], 1, 1)
    df = spark.createDataFrame([(1, bytearray(clear)), (2, bytearray(solid)), (3, bytearray(b"text"))], "id int, content binary")
    assert [r[0] for r in df.orderBy("id").select(pdf.png_has_alpha(F.col("content"))).collect()] == [True, False, False]
    flat = {r["id"]: bytes(r["content"]) for r in pdf.flatten_images(df).collect()}
    assert flat[2] == solid and flat[3] == b"text"
    assert flat[1] == png(2, [255, 255, 255, 10, 20, 30], 2, 1)


def test_scan_and_selectors(spark, tmp_path):
    for name in ("a.pdf", "b.PNG", "c.txt", "d.ocr.pdf", ".hid/e.pdf", "sub/Screenshot 2024-05-02 at 10.00.00.png"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x")
    found = lambda s: sorted(r["path"].rsplit("/", 1)[1].replace("%20", " ") for r in scan.scan_documents(spark, str(tmp_path), s).collect())
    assert found("all") == ["Screenshot 2024-05-02 at 10.00.00.png", "a.pdf", "b.PNG"]
    assert found("pdfs") == ["a.pdf"]
    for bad in ("", "pdfs,films"):
        with pytest.raises(ValueError):
            scan.parse_selectors(bad)


def test_extract_keeps_errors_as_rows(spark):
    def reader(content):
        if content == b"bad":
            raise OSError("unreadable")
        return "read " * 50

    df = spark.createDataFrame([("a", bytearray(b"img")), ("b", bytearray(b"bad"))], "path string, content binary")
    got = {r["path"]: (r["ocr_performed"], r["error"]) for r in pdf.extract(df, reader).collect()}
    assert got == {"a": (True, None), "b": (False, "unreadable")}


def test_corpus_with_one_or_many_categories(spark, tmp_path):
    (tmp_path / "c.json").write_text('[{"id": "a", "category": "X", "tags": []}, {"id": "b", "category": ["X", "Y"], "tags": ["t"]}]')
    got = {r["id"]: r["categories"] for r in scan.read_corpus(spark, str(tmp_path / "c.json")).collect()}
    assert got == {"a": ["X"], "b": ["X", "Y"]}
    assert scan.read_or_empty(spark, str(tmp_path / "none.json"), "k string").count() == 0


def test_notes_written_and_read(spark, tmp_path):
    df = spark.createDataFrame([("x/a.md", "---\ntitle: \"T\"\n---\nbody")], "path string, note string")
    assert sinks.write_notes(df, str(tmp_path)).first()["status"] == "written"
    assert scan.scan_notes(spark, str(tmp_path)).first()["content"].endswith("body")


def test_stream_ingests_each_content_once(spark, tmp_path):
    folder = tmp_path / "in"
    schema = "text string"
    spark.createDataFrame([("a",), ("a",), ("b",), ("",), (None,)], schema).coalesce(1).write.parquet(str(folder))
    check = str(tmp_path / "check")
    assert ingest.ingest_once(spark, str(folder), spark.read.parquet(str(folder)).schema, checkpoint=check).count() == 2
    spark.createDataFrame([("b",), ("c",)], schema).coalesce(1).write.mode("append").parquet(str(folder))
    for _ in range(2):
        assert ingest.ingest_once(spark, str(folder), spark.read.parquet(str(folder)).schema, checkpoint=check).count() == 3


def test_stable_files(spark):
    now = spark.createDataFrame([("a", 5), ("b", 6), ("c", 0)], "path string, length long")
    before = spark.createDataFrame([("a", 5), ("b", 2), ("c", 0)], "path string, length long")
    assert [r["path"] for r in ingest.stable_files(now, before).collect()] == ["a"]


def test_model_stage(spark):
    df = spark.createDataFrame([("alpha beta gamma",), ("",)], "prompt string")
    got = model.ask(df, model.StubClient).collect()
    assert len(got) == 2 and got[0]["response"].startswith("{")
