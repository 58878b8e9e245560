"""Every reader and writer on small files: what is written is read back."""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ordina.operators import sampling, vision
from ordina.sources import readers, writers


def _png(path, pixels: np.ndarray) -> None:
    """An 8-bit PNG of gray, colour or colour and alpha."""
    height, width, n = pixels.shape
    raw = b"".join(b"\0" + pixels[y].astype(np.uint8).tobytes() for y in range(height))
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 3: 2, 4: 6}[n], 0, 0, 0)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_catalogue(spark, tmp_path):
    (tmp_path / "c.csv").write_text('path,license,title,song_length.bars,genres,n_tracks,has_lyrics,subset:deduplicated\na,cc-zero,"two\nlines, ""so""",9,,4,True,True\nb,cc-by,t,9,x,4,True,True\nc,cc-zero,t,9,x,abc,True,True\nd,cc-zero,t,9,x,1,True,True\ne,cc-zero,t,9,x,4,true,True\n')
    rows = readers.catalogue_filter(readers.catalogue(spark, str(tmp_path / "c.csv"))).collect()
    assert [tuple(r) for r in rows] == [("a", 'two\nlines, "so"', "9", 4, "na", "cc-zero")]


def test_score_json(spark, tmp_path):
    doc = {"resolution": 480, "tracks": [{"is_drum": True, "notes": [{"time": 0, "pitch": 1, "duration": 1}]}, {"notes": [{"time": 0, "pitch": 60, "duration": 480, "pitch_str": "C"}], "lyrics": [{"time": 0, "lyric": " a "}, {"time": 0, "lyric": "b"}, {"time": 1, "lyric": "  "}]}, {"is_drum": False, "notes": []}]}
    (tmp_path / "s.json").write_text(json.dumps(doc, indent=1))
    docs = readers.score_documents(spark, str(tmp_path / "s.json"))
    assert [tuple(r)[1:] for r in readers.note_rows(docs).collect()] == [(0, 0, 0, 60, 480, "C", False)]
    assert readers.track_rows(docs).count() == 2 and [tuple(r)[1:] for r in readers.lyric_rows(docs).collect()] == [(0, 0, "b")]


def test_line_json(spark, tmp_path):
    for piece in ("p1", "p2"):
        (tmp_path / piece).mkdir()
        (tmp_path / piece / "s000v0.json").write_text(json.dumps({"voice": 1, "tokens": ["4", "c"], "width": 40}))
    assert sorted((r.piece, r.file, r.voice, r.tokens) for r in readers.json_lines(spark, str(tmp_path)).collect()) == [(p, "s000v0.json", 1, ["4", "c"]) for p in ("p1", "p2")]


def test_kern_files(spark, tmp_path):
    writers.write_pieces(spark.createDataFrame([("p", "**kern\n4c\n*-"), ("q", "**kern\n4d\n*-")], "piece string, text string"), str(tmp_path / "k"))
    writers.write_pieces(spark.createDataFrame([("p", "**kern\n4e\n*-")], "piece string, text string"), str(tmp_path / "k"))
    rows = readers.kern_records(spark, str(tmp_path / "k" / "piece=*"))
    assert sorted((r.raw, r.line_no) for r in rows.where("kind = 'data'").collect()) == [("4d", 2), ("4e", 2)]
    framed = readers.spine_fragment(rows, spine=0, start=1, end=9, header=["*clefG2"], closing="=", framed=True)
    assert sorted(r.tokens for r in framed.collect()) == [["**kern", "*clefG2", t, "=", "*-"] for t in ("4d", "4e")]
    assert readers.drop_labels(readers.parse_kern(spark.createDataFrame([("p", "*I'x\n4c")], "path string, value string"))).count() == 1


def test_pages(spark, tmp_path):
    gray = np.arange(12, dtype=np.uint8).reshape(3, 4)
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a.bin").write_bytes(gray.tobytes())
    page = readers.raw_pages(spark, str(tmp_path / "raw"), width=4).first()
    assert (page.height, page.width, bytes(page.gray)) == (3, 4, gray.tobytes())
    (tmp_path / "png").mkdir()
    colour = np.zeros((2, 2, 4))
    colour[0, 0], colour[0, 1], colour[1, 0], colour[1, 1] = (255, 0, 0, 255), (0, 255, 0, 255), (0, 0, 255, 255), (9, 9, 9, 0)
    _png(tmp_path / "png" / "a.png", colour)
    got = np.frombuffer(readers.image_pages(spark, str(tmp_path / "png")).first().gray, np.uint8)
    assert got.tolist() == [76, 150, 29, 255]  # luma of red, green and blue; paper
    (tmp_path / "gray").mkdir()
    _png(tmp_path / "gray" / "a.png", gray[..., None])
    assert bytes(readers.image_pages(spark, str(tmp_path / "gray")).first().gray) == gray.tobytes()


def test_crops(spark):
    gray = np.full((200, 300), 255, np.uint8)
    for k in range(5):
        gray[80 + 10 * k : 82 + 10 * k, 20:280] = 0
    pages = spark.createDataFrame([(1, 200, 300, bytearray(gray.tobytes()))], "page bigint, height int, width int, gray binary")
    boxes = vision.detect_pages(pages)
    assert [(r.x, r.w, r.voice) for r in boxes.collect()] == [(20, 260, 0)]
    line = vision.crop_lines(pages, boxes).first()
    assert len(line.pixels) == 128 * line.width and min(line.pixels) == 0
    stats = vision.stats_pages(pages).first()
    assert stats.run_frac == pytest.approx(260 / 300) and 0.9 < stats.white_frac < 1


def test_packs(spark, tmp_path):
    lines = spark.createDataFrame([("p", i, 10 + i, ["4"]) for i in range(4)] + [("q", 0, 7, ["2"])], "piece string, n int, width int, tokens array<string>")
    n = writers.write_pack(lines, str(tmp_path / "pack"), height=128, order=["n"])
    got = readers.pack(spark, str(tmp_path / "pack"), pieces=spark.createDataFrame([("p",)], "piece string"), source=lines, made_from=n)
    assert [r.offset for r in got.orderBy("n").collect()] == [0, 1280, 2688, 4224]
    with pytest.raises(ValueError, match="derived"):
        readers.pack(spark, str(tmp_path / "pack"), source=lines.limit(2), made_from=n)
    assert readers.pack(spark, str(tmp_path / "pack"), source=lines.limit(2), made_from=n, allow_partial=True).count() == 5
    fixtures = writers.write_fixtures(lines, str(tmp_path / "some"), order=["width", "piece", "n"], k=3)
    assert fixtures == 3 and sorted(r.width for r in spark.read.parquet(str(tmp_path / "some")).collect()) == [7, 11, 13]


SVG = """<svg xmlns="http://www.w3.org/2000/svg"><g class="system"><g class="measure" id="m-L5"><g class="staff" id="s-L1F2"><path d="M0 300 L9 300"/><g class="clef"/></g>
<g class="staff" id="s-L1F1"><path d="M0 100 L9 100"/><g class="meterSig"/></g><g class="staff" id="none"/></g><g class="measure" id="m-L9"><g class="staff" id="s-L9F1"/></g></g>
<g class="system"><g class="measure" id="m-L12"><g class="staff" id="s-L12F1"><path d="M0 900 L9 900"/></g></g></g><g class="system"/></svg>"""


def test_svg(spark, tmp_path):
    (tmp_path / "a.svg").write_text(SVG)
    systems = readers.svg_systems(spark, str(tmp_path / "a.svg"))
    got = systems.orderBy("system").collect()
    assert [(r.system, r.starts, [tuple(s) for s in r.staves]) for r in got] == [(0, [5, 9], [(1, 100.0, False, False, True), (2, 300.0, True, False, False)]), (1, [12], [(1, 900.0, False, False, False)])]
    text = "\n".join(["**kern"] * 6 + ["4c"] * 5 + ["=7", "4d", "*-"])
    records = readers.parse_kern(spark.createDataFrame([(got[0].path, text)], "path string, value string"))
    assert sorted(tuple(r)[1:] for r in readers.system_ranges(systems, records).collect()) == [(0, 7, 11, "=7"), (1, 12, 13, None)]


def test_position_files(spark, tmp_path):
    for name, ys in (("a", [1.0, 1.0, 5.0]), ("b", [1.0, 7.0, 7.04])):
        (tmp_path / f"{name}.mpos").write_text("<score><elements>" + "".join(f'<element id="{i}" page="0" y="{y}"/>' for i, y in enumerate(ys)) + "</elements></score>")
    rows = readers.xml_systems(spark, str(tmp_path)).collect()
    found: dict = {}
    for r in sorted(rows, key=lambda r: (r.path, r.element)):
        found.setdefault(r.path[-6:], []).append(r.system)
    assert found == {"a.mpos": [1, 1, 2], "b.mpos": [1, 2, 2]}


def test_lists(spark, tmp_path):
    (tmp_path / "q.json").write_text('[{"piece": "a",\n "exit": 1},\n "b", "a"]')
    assert sorted(r.piece for r in readers.name_list(spark, str(tmp_path / "q.json")).collect()) == ["a", "b"]
    (tmp_path / "v.json").write_text('["4", "c"]')
    assert [tuple(r) for r in readers.vocabulary_file(spark, str(tmp_path / "v.json")).orderBy("id").collect()] == [("4", 1), ("c", 2)]
    lines = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "piece string, n int")
    names = readers.name_list(spark, str(tmp_path / "q.json"))
    assert sampling.named_split(lines, names).count() == 2
    with pytest.raises(ValueError, match="missing"):
        sampling.named_split(lines.limit(1), names)
    keys = spark.sql("select map('b', '1', 'a', '2') as m union all select map('a', '2', 'b', '1')").select(sampling.option_key("m").alias("k")).collect()
    assert keys[0].k == keys[1].k


def test_documents_and_results(spark, tmp_path):
    writers.write_documents(spark.createDataFrame([('{"a":1}',)], "document string"), str(tmp_path / "d"))
    assert spark.read.json(str(tmp_path / "d")).first().a == 1
    writers.write_summary(spark.range(3).agg(F.count("*").alias("n")), str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).first().n == 3
    rows = spark.createDataFrame([("x", 1), ("y", 2)], "k string, n int")
    for _ in range(2):
        writers.write_append_new(rows, str(tmp_path / "a"), key=["k"])
    assert spark.read.parquet(str(tmp_path / "a")).count() == 2
    for part in (rows, spark.createDataFrame([("y", 5), ("z", 6)], "k string, n int")):
        writers.write_merged(part, str(tmp_path / "m"), key=["k"])
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "m")).collect())) == [("x", 1), ("y", 5), ("z", 6)]
    assert spark.range(1).select(writers.line_name(F.lit(7), F.lit(2)).alias("n")).first().n == "s007v2"


def test_numbers_follow_order(spark):
    rows = spark.range(1000).selectExpr("id", "(id * 7919) % 1000 as v").repartition(7)
    got = sampling.number_rows(rows, order=["v"], name="n")
    assert got.where("n <> v + 1").count() == 0 and got.count() == 1000
    assert sampling.number_rows(rows.limit(0), order=["v"], name="n").collect() == []
