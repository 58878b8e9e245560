"""Hand-worked examples of the token grammar, the score document, the notation and the page detector."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ordina.functions import metrics, numbers
from ordina.functions import tokens as T
from ordina.operators import aggregates, gates, joins, notes, score, sequence, vision
from ordina.sources import readers


def column(spark, expression, **values):
    """The value of an expression over one row of literals."""
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(expression.alias("x")).first().x


@pytest.mark.parametrize(
    ("token", "parts"),
    [("4cc", "4 cc"), ("8bL", "8 b L"), ("[2a", "[ 2 a"), ("16A#JJ", "16 A # JJ"), ("4gnX", "4 g n"), ("4ry", "4 r"), ("*clefG2", "*clefG2"), ("=||", "=||"), ("<b>", "<b>"), (".", ".")],
)
def test_split_token(spark, token, parts):
    assert " ".join(column(spark, T.split_token(F.col("t")), t=token)) == parts


def test_durations(spark):
    want = {"4": 48, "4.": 72, "4..": 84, "0": 384, "12": 16, "32..": 10, "cc": None}
    rows = spark.createDataFrame([(k,) for k in want], "t string").select("t", T.duration(F.col("t")).alias("d")).collect()
    assert {r.t: r.d.divisions if r.d else None for r in rows} == want


def test_pitches(spark):
    want = {"cc": ("C", 5), "c": ("C", 4), "C": ("C", 3), "CC": ("C", 2), "r": None, "cd": None}
    rows = spark.createDataFrame([(k,) for k in want], "t string").select("t", T.pitch_step(F.col("t")).alias("p")).collect()
    assert {r.t: tuple(r.p) if r.p else None for r in rows} == want


def test_spelled_pitches(spark):
    want = [(60, "C", "c"), (72, "C", "cc"), (48, "C", "C"), (36, "C", "CC"), (70, "Bb", "b-"), (66, "F#", "f#"), (60, "B#", "B#"), (61, "C", None)]
    rows = spark.createDataFrame(want, "m int, s string, want string").select("want", T.spell_pitch(F.col("m"), F.col("s")).alias("got")).collect()
    assert [r.got for r in rows] == [r.want for r in rows]


def test_written_lengths(spark):
    want = {480: "4", 720: "4.", 160: "12", 1200: "2 8", 2160: "1 8", 96: None, 0: None}
    rows = spark.createDataFrame([(k,) for k in want], "n int").select("n", F.array_join(T.duration_codes(F.col("n")), " ").alias("c")).collect()
    assert {r.n: r.c for r in rows} == want


def test_beam_groups(spark):
    got = [column(spark, T.beam_group(F.col("a"), F.col("b")), a=a, b=b) for a, b in ((6, 8), (4, 4), (2, 2), (3, 8))]
    assert got == [720, 480, 960, 480]


def test_joins_of_tokens(spark):
    assert column(spark, T.join_legacy(F.split("t", " ")), t="4 f # [ 2 a") == ["4f#[", "2a"]
    assert column(spark, T.join_records(F.split("t", " ")), t="4 f # <b> [ 2 a") == ["4f#", "[2a"]


def test_frames_and_error_rate(spark):
    for text, n in (("a a b", 4), ("a", 1)):
        assert column(spark, numbers.ctc_min_frames(F.split("t", " ")), t=text) == n
    assert column(spark, numbers.ctc_min_frames(F.expr("cast(array() as array<string>)")), t="") == 0
    rate = metrics.error_rate(F.col("a"), F.col("b"))
    assert column(spark, rate, a="4c|4d", b="4c|2d") == pytest.approx(0.2)
    assert column(spark, rate, a="", b="") == 0 and column(spark, rate, a="", b="x") == 1
    assert column(spark, metrics.token_error_rate(F.split("a", " "), F.split("b", " ")), a="4 c", b="4 d") == 0.5
    many = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(399)), lambda i: i.cast("string")).alias("a"))
    other = F.transform("a", lambda t: F.when(t.cast("int") >= 256, (t.cast("int") - 256).cast("string")).otherwise(t))
    assert many.select(metrics.token_error_rate(F.col("a"), other).alias("x")).first().x == pytest.approx(144 / 400)
    assert metrics._script([], ["a"]) == [{"op": "ins", "ref": None, "hyp": "a"}] and metrics._script("a b c".split(), ["b"]) == [{"op": "del", "ref": "a", "hyp": None}, {"op": "del", "ref": "c", "hyp": None}]
    assert metrics._script("4 c <b> 4 d".split(), "4 c <b> 2 d".split()) == [{"op": "sub", "ref": "4", "hyp": "2"}]


def _bar(name: str, at: int) -> list[dict]:
    return [{"token": name, "f0": at, "f1": at, "confidence": 0.5}]


@pytest.mark.parametrize(("given_", "left"), [("= =", "= ="), ("= ==", "= =="), ("=|| =", "=||"), ("== =", "=="), ("= =||", "=||"), ("= = =||", "=||")])
def test_barline_collapse(given_, left):
    out = score.collapse_barline_records([_bar(t, i) for i, t in enumerate(given_.split())])
    assert " ".join(r[0]["token"] for r in out) == left
    assert out[0][0]["f0"] == 0 and out[-1][-1]["f1"] == len(given_.split()) - 1


@given(st.lists(st.sampled_from(["=", "==", "=||", "4"]), max_size=12))
def test_collapse_leaves_kept_pairs_only(names):
    out = [r[0]["token"] for r in score.collapse_barline_records([_bar(t, i) for i, t in enumerate(names)])]
    assert all((a, b) in score.KEPT_PAIRS for a, b in zip(out, out[1:]) if a[0] == "=" and b[0] == "=")
    assert out.count("4") == names.count("4")


def test_score_document(spark):
    text = "*clefG2 <b> *k[] <b> = <b> 4 c <b> 8 d <b> 8 e <b> 2 f <b> = <b> 2 g <b> [ 2 a <b> =="
    event = F.struct(F.col("t").alias("token"), F.col("i").cast("int").alias("f0"), F.col("i").cast("int").alias("f1"), F.lit(0.9).alias("confidence"))
    rows = spark.range(1).select(F.posexplode(F.split(F.lit(text), " ")).alias("i", "t")).groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("i", event.alias("e")))), lambda x: x["e"]).alias("events"))
    lines = score.line_elements(rows).select(F.lit(1).alias("score"), F.lit(0).alias("page"), F.lit(0).alias("system"), F.lit(0).alias("staff"), F.lit(False).alias("truncated"), "elements")
    done = score.assemble(lines)
    measures = done["measures"].orderBy("measure").collect()
    assert [sum(e.duration.divisions for e in m.events) for m in measures] == [0, 192, 192]
    assert measures[0].clef.sign == "G" and measures[0].key_fifths == 0 and measures[0].barline.type == "regular"
    assert measures[2].events[-1].tie == "start" and measures[2].barline.type == "final"
    assert done["structure"].first().staves == 1 and done["warnings"].count() == 0


@pytest.mark.parametrize(
    ("sizes", "small", "large", "verdict"),
    [([2, 2, 3, 4], 2, 2, aggregates.MIXED), ([1, 1, 1], 1, 1, aggregates.STEADY), ([2, 2, 2, 1], 2, 2, aggregates.CLOSED), ([4, 4, 3, 3], 3, 4, aggregates.MIXED), ([4, 4, 4, 3], 4, 4, aggregates.SUSPECT), ([4, 4, 4, 4, 5], 4, 4, aggregates.STEADY), ([2, 2, 2], 2, 2, aggregates.CLOSED)],
)
def test_modes(spark, sizes, small, large, verdict):
    rows = spark.createDataFrame([(1, i, s) for i, s in enumerate(sizes)], "k int, i int, s int")
    assert aggregates.mode(rows, keys=["k"], value="s", tie="smaller").first().mode == small
    assert aggregates.mode(rows, keys=["k"], value="s", tie="larger").first().mode == large
    got = aggregates.consistency(rows, keys=["k"], index="i", size="s", pieces=spark.range(1, 3).withColumnRenamed("id", "k")).orderBy("k").collect()
    assert [r.verdict for r in got] == [verdict, aggregates.EMPTY] and (got[1].mode, got[1].share) == (None, 0.0)
    assert [(x.system, x.missing) for x in got[0].suspects] == ([(i, large - s) for i, s in enumerate(sizes) if s < large] if verdict == aggregates.SUSPECT else [])


def test_medians(spark):
    got = spark.createDataFrame([(x,) for x in (1, 2, 10, 20)], "x int").agg(aggregates.median_or_zero("x").alias("m"), aggregates.upper_median("x").alias("u")).first()
    assert (got.m, got.u) == (6.0, 10)


@pytest.mark.parametrize(("white", "staves", "reason", "scan"), [(0.95, [4, 4], None, False), (0.95, [2, 2], "closed-score-suspected", False), (0.80, [2, 2], None, True), (0.95, [], "no-staves-found", False)])
def test_scan_decision(spark, white, staves, reason, scan):
    pages = spark.createDataFrame([(1, white, 0.6)], "k int, white_frac double, run_frac double")
    got = aggregates.scan_decision(pages, spark.createDataFrame([(1, s) for s in staves], "k int, staves int"), keys=["k"]).first()
    assert (got.reason, got.scan_suspected, got.rejected) == (reason, scan, reason is not None)


def test_staves():
    lines = [(10, 11), (20, 21), (30, 31), (40, 41), (50, 51)]
    (staff,) = vision.group_staves(np.array(lines))
    assert (staff["top"], staff["bottom"], staff["line_spacing"]) == (10, 51, 10.0)
    assert vision.group_staves(np.array(sorted([*lines, (25, 26)]))) == [staff]
    assert vision.group_staves(np.array(lines[:4])) == []


def test_normalised_line():
    crop = np.ones((80, 50), np.float32)
    crop[20] = 0
    line = vision.normalise(crop, 10.0, 20.0)
    assert line.shape == (128, 50) and line[44].max() == 0 and line[:44].min() == 1


def test_state_before_a_line(spark):
    rows = [(1, "**kern"), (2, "*clefF4"), (3, "*k[f#]"), (4, "*M4/4"), (5, "*MM120"), (6, "4c"), (7, "*clefG2"), (8, "4d")]
    df = spark.createDataFrame([("p", n, t) for n, t in rows], "piece string, n int, t string")
    states = {"clef": F.when(F.startswith("t", F.lit("*clef")), F.col("t")), "meter": F.when(F.rlike("t", F.lit(r"^\*M\d")), F.col("t"))}
    got = {r.n: (r.clef, r.meter) for r in joins.asof_strict(df, keys=["piece"], order=["n"], states=states).collect()}
    assert got[7] == ("*clefF4", "*M4/4") and got[8] == ("*clefG2", "*M4/4") and got[2] == (None, None)


def test_kern_lines(spark):
    text = spark.createDataFrame([("p", "!!c\r\n**kern\t**kern\n\n*clefG2\t*clefF4\n4c\t.\n=1\t=1\n8d\t4e")], "path string, value string")
    rows = readers.parse_kern(text)
    assert [(r.line_no, r.kind) for r in rows.orderBy("line_no").collect()] == [(1, "global"), (2, "interp"), (4, "interp"), (5, "data"), (6, "barline"), (7, "data")]
    assert readers.spine_fragment(rows, spine=1, start=4, end=7, header=["*clefF4"], closing="==").first().tokens == ["*clefF4", "=1", "4e", "=="]
    assert readers.spine_types(rows).first().spine_types == ["**kern", "**kern"]


def test_decoded_spans(spark):
    frames = spark.createDataFrame([(1, i, c, 0.5761) for i, c in enumerate("0110220")], "k int, f int, c string, p double")
    got = [tuple(r)[2:] for r in sequence.decode_spans(frames, keys=["k"], order=["f"], symbol="c", blank="0", weight="p").orderBy("f0").collect()]
    assert got == [("1", 1, 2, 0.5761), ("2", 4, 5, 0.5761)]
    frames = spark.createDataFrame([(1, i, c) for i, c in enumerate("101")], "k int, f int, c string")
    assert sequence.collapse(frames, keys=["k"], order=["f"], symbol="c", blank="0").count() == 2


def test_notation(spark):
    """A quarter, a gap, a note over the bar line, and two eighths that are beamed."""
    rows = [(0, 480, 60), (960, 1440, 62), (2400, 240, 64), (2640, 240, 65)]
    played = spark.createDataFrame([("p", 0, i, t, p, d, s, False) for i, ((t, d, p), s) in enumerate(zip(rows, "CDEF"))], "piece string, track int, pos int, time long, pitch int, duration long, spelled string, is_grace boolean")
    bars = spark.createDataFrame([("p", t) for t in (0, 1920, 3840)], "piece string, time long")
    meters = spark.createDataFrame([("p", 0, 4, 4), ("p", 3840, 6, 8)], "piece string, time long, num int, den int")
    got = [r.token for r in notes.notate(played, bars, meters).orderBy("time").collect()]
    assert got == ["4c", "4r", "[2d", "4d]", "8eL", "8fJ"]


def test_reasons(spark):
    rows = gates.with_reason(spark.range(4), [(F.col("id") == 1, "a -- x"), (F.col("id") < 3, "b")])
    assert [r.reject_reason for r in rows.orderBy("id").collect()] == ["b", "a -- x", "b", None]
    assert tuple(gates.funnel(rows).first()) == (4, 1, 3)
    with pytest.raises(ValueError, match="derived"):
        gates.require_fresh(rows, 5)


def test_systems_by_ink(spark):
    staves = spark.createDataFrame([(1, 0, 10, 20), (1, 1, 30, 40), (1, 2, 60, 70)], "page int, staff int, top int, bottom int")
    ink = spark.createDataFrame([(1, y, 5) for y in range(21, 30)] + [(1, y, 5) for y in range(41, 45)], "page int, y int, x int")
    got = {r.staff: r.joined for r in joins.connected_gaps(staves, ink).collect()}
    assert got == {0: False, 1: True, 2: False}


def test_streaming_collapse(spark, tmp_path):
    from ordina.streaming.collapse import collapse_stream, windowed_counts

    schema = "user_id long, event_id long, event_type string, ts timestamp_ntz, value double"
    for part, types in enumerate((["a", "a", "view", "a"], ["a", "b", "b"])):
        rows = [(1, 10 * part + i, t) for i, t in enumerate(types)]
        spark.createDataFrame(rows, "user_id long, event_id long, event_type string").selectExpr("*", "timestamp_ntz'2024-01-01 00:00:00' as ts", "1.0d as value").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = collapse_stream(stream, key="user_id", order="event_id", symbol="event_type", blank="view")
    run = out.writeStream.format("memory").queryName("collapsed").outputMode("append").start()
    run.processAllAvailable()
    run.stop()
    assert [r.event_type for r in spark.table("collapsed").orderBy("event_id").collect()] == ["a", "a", "b"]
    counts = windowed_counts(stream, time="ts", symbol="event_type").writeStream.format("memory").queryName("counted").outputMode("complete").start()
    counts.processAllAvailable()
    counts.stop()
    assert {r.event_type: r.n for r in spark.table("counted").collect()} == {"a": 4, "view": 1, "b": 2}


def test_augmented_spines(spark):
    from ordina.operators import augment

    text = spark.createDataFrame([("p", "!!!c\n**kern\t**kern\n*clefF4\t*clefG2\n4c\t4e\n[4d\t.\n=1\t=1\n4d]\t8r\n4c\t4gg\n*-\t*-")], "path string, value string")
    records = readers.parse_kern(text).persist()
    chosen = spark.createDataFrame([("p", 2, True, 1, [0], True)], "path string, n_spines int, lyrics boolean, verses int, dynamic_voices array<int>, harmony boolean")
    assert [(r.role, r.spine) for r in augment.layout(chosen).orderBy("pos").collect()] == [("kern", 0), ("dynam", 0), ("text", 0), ("kern", 1), ("text", 1), ("harm", 1)]
    words = augment.attach_lyrics(augment.events(records), [["Ky-", "rie"]], verses=1)
    assert {(r.spine, r.line_no): r.text for r in words.collect()} == {(0, 4): "Ky-", (0, 5): "rie", (0, 8): "Ky-", (1, 4): "Ky-", (1, 8): "rie"}
    lines = augment.augment(records, chosen, seed="s", syllables=[["Ky-", "rie"]]).first().text.split("\n")
    assert lines[:4] == ["!!!c", "**kern\t**dynam\t**text\t**kern\t**text\t**mxhm", "*\t*\t*\t*\t*\t*above", "*clefF4\t*\t*\t*clefG2\t*\t*"]
    assert [x.split("\t")[2] for x in lines[4:]] == ["Ky-", "rie", "=1", ".", "Ky-", "*-"]
    assert all(len(x.split("\t")) == 6 for x in lines[1:])
    voices = spark.createDataFrame([("p", i, n) for i, n in enumerate((5, 8, 60, 400))], "path string, spine int, n int")
    plan = sorted(map(tuple, augment.hairpins(voices, seed="k").collect()))
    assert plan == sorted(map(tuple, augment.hairpins(voices.repartition(3), seed="k").collect()))
    assert all(0 <= at < (5, 8, 60, 400)[i] for _, i, at, _ in plan) and not any(i == 0 for _, i, _, _ in plan) and len({at for _, i, at, _ in plan if i == 3}) == sum(i == 3 for _, i, _, _ in plan)
    walk = [m for _, i, _, m in plan if i == 3 and m in "<>[]"]
    assert len(walk) > 10 and all(b == {"<": "[", ">": "]"}[a] for a, b in zip(walk[::2], walk[1::2]))
    drawn = augment.options(spark.range(300).selectExpr("concat('p', id) as path", "4 as n_spines"), seed="s").collect()
    assert 200 < sum(r.lyrics for r in drawn) < 250 and 60 < sum(r.harmony for r in drawn) < 150


def _played(rows):
    return [("p", t, i, 480 * i * 2, p, d, n, False) for t, (p, d, n) in enumerate(rows) for i in range(8)]


NOTES = "piece string, track int, pos int, time long, pitch int, duration long, spelled string, is_grace boolean"


def test_typed_text(spark):
    """Two voices, the lower one first, bars and a later meter between the notes."""
    played = spark.createDataFrame(_played([(72, 480, "C"), (48, 960, "C")]), NOTES)
    bars = spark.createDataFrame([("p", t) for t in (0, 1920, 3840, 5760)], "piece string, time long")
    meters = spark.createDataFrame([("p", 0, 4, 4), ("p", 3840, 2, 2)], "piece string, time long, num int, den int")
    text = notes.to_kern(played, bars, meters, spark.createDataFrame([("p", -1)], "piece string, fifths int")).first().text.split("\n")
    assert text[:4] == ["**kern\t**kern", "*clefF4\t*clefG2", "*k[b-]\t*k[b-]", "*M4/4\t*M4/4"] and text[-2:] == ["==\t==", "*-\t*-"]
    assert text[4:8] == ["2C\t4cc", ".\t4r", "2C\t4cc", ".\t4r"] and text[8] == "=2\t=2" and text[13:15] == ["=3\t=3", "*M2/2\t*M2/2"]
    records = readers.parse_kern(spark.createDataFrame([("p", "\n".join(text))], "path string, value string"))
    assert records.where("kind = 'data' and size(fields) <> 2").count() == 0


def test_pieces_that_cannot_be_written(spark):
    bars = spark.createDataFrame([("p", t) for t in (0, 1920, 3840, 5760)], "piece string, time long")
    pieces = spark.createDataFrame([("p", 480, 1)], "piece string, resolution int, n_meters int")
    tracks = spark.createDataFrame([("p", i) for i in range(3)], "piece string, track int")

    def reason(rows, of=None):
        return notes.piece_reasons(pieces, spark.createDataFrame(_played(rows), NOTES), bars, of).first().reject_reason

    good = [(60, 480, "C"), (64, 480, "E")]
    assert reason(good) is None and reason(good, tracks) == "fewer than eight notes"
    assert reason([(60, 480, "C"), (61, 480, "C")]) == "spelling" and reason([(60, 479, "C"), (64, 480, "E")]) == "length"
    assert reason([(60, 479, "C"), (65, 480, "E")]) == "length" and reason([(60, 480, "C")]) == "track count"


def test_beats_of_the_first_meter(spark):
    """Eighths in 6/8 are beamed in threes though the piece goes on in 4/4."""
    played = spark.createDataFrame([("p", 0, i, 240 * i, 60, 240, "C", False) for i in range(6)], NOTES)
    bars = spark.createDataFrame([("p", t) for t in (0, 1440)], "piece string, time long")
    meters = spark.createDataFrame([("p", 0, 6, 8), ("p", 1440, 4, 4)], "piece string, time long, num int, den int")
    assert [r.token for r in notes.notate(played, bars, meters).orderBy("time").collect()] == ["8cL", "8c", "8cJ"] * 2


def test_whole_document(spark):
    import json

    event = "struct<token:string,f0:int,f1:int,confidence:double>"
    token = lambda t, i: (t, i, i, 0.9)
    texts = {0: "*clefGv2 <b> *k[f#] <b> *M3/4 <b> 4 f # <b> =||", 1: "*clefF4 <b> 4 c <b> x <b> ==", 2: "2 c"}
    rows = [(1, 0, s, i, i == 1, [token(t, k) for k, t in enumerate(texts[i].split())], 10, 100 * i, 50, 40, 9.0, 10.0) for s, n in ((0, 2), (1, 2), (2, 3)) for i in range(n)]
    lines = score.line_elements(spark.createDataFrame(rows, f"score int, page int, system int, staff int, truncated boolean, events array<{event}>, x int, y int, w int, h int, spacing double, norm_spacing double"))
    verdicts = spark.createDataFrame([(1, True, "closed-score-suspected", 3, ["closed-score"])], "score int, rejected boolean, reason string, modal_staves int, codes array<string>")
    done = json.loads(score.to_documents(score.assemble(lines, verdicts), model="m", decoder="d").first().document)
    assert done["generator"] == {"model": "m", "decoder": "d"} and done["rejected"] and done["rejectionReason"] == "closed-score-suspected"
    assert done["structure"]["recognized"] == {"stavesPerSystem": 2, "clefs": ["G2v8", "F4"], "keyFifths": 1, "time": {"num": 3, "den": 4}}
    assert [w["code"] for w in done["warnings"]][:3] == ["closed-score", "modal-staves-disagreement", "staff-count-mismatch"] and done["warnings"][2]["found"] == 3
    assert [len(p["measures"]) for p in done["parts"]] == [3, 3] and done["parts"][0]["measures"][0]["attributes"]["keyFifths"] == 1
    assert done["parts"][0]["measures"][0]["events"][0]["pitch"] == {"step": "F", "octave": 4, "alter": 1} and done["parts"][1]["measures"][2]["barline"]["type"] == "final"
    assert done["systems"][2]["bbox"] == [10, 0, 50, 240] and done["systems"][0]["staves"][1] == {"part": 1, "bbox": [10, 100, 50, 40], "lineSpacingPx": 9.0, "normScale": 0.9}


def test_parity(spark):
    schema = "k int, voice int, bar int, total int, notes int"
    base = [(1, v, b, 4, 4) for v in (0, 1) for b in range(3)]

    def first(mine):
        return joins.parity(spark.createDataFrame(mine, schema), spark.createDataFrame([*base, (1, 0, 9, 0, 0), (1, 1, 9, 6, 6)], schema), keys=["k"], voice="voice", bar="bar").first().violation

    mine = [*base, (1, 1, 7, 6, 6)]
    assert first(mine) is None and first([r for r in mine if r[1] == 0]) == "voices" and first(mine[:-1]) == "bar count"
    change = lambda i, total, n: [(*r[:3], total, n) if j == i else r for j, r in enumerate(mine)]
    assert first(change(3, 6, 4)) is None and first(change(3, 7, 4)) == "total" and first(change(0, 5, 4)) == "total" and first(change(3, 3, 4)) == "total" and first(change(4, 6, 5)) == "notes"


def test_build_reasons(spark):
    good = ("**kern", ["**kern"] * 2, 0, 1, 1, [0], [0], [2], [2], [[1, 2]], [1, 2])
    schema = "text string, spine_types array<string>, n_multirests int, n_systems int, n_detected int, pages array<int>, detected_pages array<int>, staves array<int>, detected_staves array<int>, fields array<array<int>>, kern_fields array<int>"
    faults = [(0, "a *^ b"), (1, ["**kern"]), (1, ["**kern", "**text"]), (2, 1), (3, 0), (4, 2), (6, [1]), (8, [3]), (9, [[1, 3]])]
    rows = [good, *[(*good[:i], x, *good[i + 1 :]) for i, x in faults]]
    got = [r.why for r in spark.createDataFrame(rows, schema).coalesce(1).select(gates.build_reasons().alias("why")).collect()]
    assert got == [None, "spine split", "spine count", "other spines", "multirest", "no systems", "system count", "system on another page", "staff count", "fields"]


def test_padding():
    """Up to the first clear gap, at least two and at most three spacings, bounded by the neighbour and the page."""
    rows = np.ones(60, bool)
    assert vision.clear_rows(rows, 10.0, None) == 30 and vision.clear_rows(rows, 10.0, 24.6) == 24 and vision.clear_rows(rows, 10.0, 5.0) == 20
    assert vision.clear_rows(rows[:25], 10.0, None) == 25 and vision.clear_rows(rows[:7], 10.0, None) == 20
    rows[21:29] = False
    assert vision.clear_rows(rows, 10.0, None) == 21 and vision.clear_rows(rows, 10.0, 28.0) == 28
