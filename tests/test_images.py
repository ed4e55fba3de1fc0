"""Image files: sizes from bytes, names resolved to files, equal contents numbered once."""

import struct

import pytest

from scriptorium.sources import images


def png(width, height):
    return bytes.fromhex(images.PNG) + struct.pack(">I4sII", 13, b"IHDR", width, height) + b"\x08\x06\x00\x00\x00"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("images")
    (top / "a.png").write_bytes(png(640, 65_536))
    (top / "a.jpg").write_bytes(b"\xff\xd8")
    (top / "short.png").write_bytes(png(1, 1)[:20])
    (top / "notes.txt").write_text("no image")
    return top


def test_sizes(spark, folder):
    got = images.image_files(spark, str(folder)).select("path", images.png_size(images.F.col("content")).alias("s"))
    sizes = {r["path"].rsplit("/")[-1]: r["s"] and tuple(r["s"]) for r in got.collect()}
    assert sizes == {"a.png": (640, 65_536), "a.jpg": None, "short.png": None}


def test_resolved(spark, folder):
    files = images.image_files(spark, str(folder))
    where = files.first()["path"].rsplit("/", 1)[0]
    names = spark.createDataFrame([(where, "a"), (where, "a.jpg"), (where, "absent"), (where, "a"), (None, "a")], "dir string, name string")
    got = sorted((r["name"], r["path"] and r["path"].rsplit("/")[-1]) for r in images.resolved(names, files).where("dir IS NOT NULL").collect())
    assert got == [("a", "a.png"), ("a", "a.png"), ("a.jpg", "a.jpg"), ("absent", None)]


def test_numbered(spark):
    media = spark.createDataFrame([("d", "x", b"1"), ("d", "y", b"1"), ("d", "z", b"2"), ("e", "x", b"1")], "doc string, name string, content binary")
    got = {(r["doc"], r["name"]): r["media_id"] for r in images.numbered(media, "doc").collect()}
    assert got["d", "x"] == got["d", "y"] != got["d", "z"] and got["e", "x"] == 1
    assert {got["d", "x"], got["d", "z"]} == {1, 2}


def jpeg(width, height):
    segment = lambda kind, body: b"\xff" + bytes([kind]) + struct.pack(">H", 2 + len(body)) + body
    tables = segment(0xE0, b"JFIF\0\xff\xc0\0\x11\x08\1\1\1\1") + segment(0xC4, b"\xff\xc2" * 9)
    return b"\xff\xd8" + tables + b"\xff" + segment(0xC2, struct.pack(">BHHB", 8, height, width, 3) + b"\1\x11\0" * 3) + b"\xff\xd9"


def test_image_sizes(spark):
    rows = [(1, jpeg(640, 65_535)), (2, jpeg(640, 480)[:40]), (3, png(3, 4)), (4, b""), (5, None), (6, b"\xff\xd8\xff"), (7, b"%PDF" * 9)]
    media = spark.createDataFrame(rows, "n int, content binary")
    got = {r["n"]: tuple(r["s"]) for r in media.select("n", images.image_size(images.F.col("content")).alias("s")).collect()}
    assert got == {1: (640, 65_535), 3: (3, 4), **{n: images.DEFAULT_SIZE for n in (2, 4, 5, 6, 7)}}
