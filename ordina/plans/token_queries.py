"""Queries of the token functions, on tokens made alike in both engines from the event ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tokens as T
from ..operators import notes
from .registry import K_SQL, events, query, table, with_k

_DURATIONS = ["4", "8.", "16", "2", "1"]
_LETTERS = ["c", "dd", "E", "FF", "g", "r", "aa"]
_ACCIDENTALS = ["", "#", "-"]
_TAILS = ["", "L", "J]", "X", "LL;"]


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v + "'" for v in values) + "]"


def _pick(values, by: str, n: int):
    return F.get(F.array(*map(F.lit, values)), F.col(by).cast("int") % n)


_TOKENS = f"""WITH t AS (SELECT event_id, {_sql_list(_DURATIONS)}[event_id % 5 + 1] AS d, {_sql_list(_LETTERS)}[event_id % 7 + 1] AS p,
CASE WHEN event_id % 7 = 5 THEN '' ELSE {_sql_list(_ACCIDENTALS)}[event_id % 3 + 1] END AS a, {_sql_list(_TAILS)}[event_id // 35 % 5 + 1] AS z, CASE WHEN event_id % 11 = 0 THEN '[' ELSE '' END AS b FROM events)"""


def _tokens(spark, sf):
    rows = events(spark, sf).select("event_id", _pick(_DURATIONS, "event_id", 5).alias("d"), _pick(_LETTERS, "event_id", 7).alias("p"), F.floor(F.col("event_id") / 35).alias("q"))
    accidental = F.when(F.col("event_id") % 7 == 5, "").otherwise(_pick(_ACCIDENTALS, "event_id", 3))
    rows = rows.withColumns({"a": accidental, "z": _pick(_TAILS, "q", 5), "b": F.when(F.col("event_id") % 11 == 0, "[").otherwise("")})
    return rows.withColumn("token", F.concat("b", "d", "p", "a", "z"))


@query(f"""{_TOKENS} SELECT event_id, array_to_string(list_filter([b, d, p, a], lambda x: x <> '') || CASE z WHEN 'J]' THEN ['J', ']'] WHEN 'LL;' THEN ['LL', ';'] WHEN 'L' THEN ['L'] ELSE [] END, ' ') AS parts FROM t""")
def token_split(spark, sf):
    return _tokens(spark, sf).select("event_id", F.array_join(T.split_token(F.col("token")), " ").alias("parts"))


@query(f"{_TOKENS} SELECT event_id, b || d || p || a || CASE z WHEN 'X' THEN '' ELSE z END AS canonical, p AS pitch, p <> 'r' AND z <> 'J]' AS sung FROM t")
def token_pitch(spark, sf):
    token = F.col("token")
    return _tokens(spark, sf).select("event_id", T.canonical_token(token).alias("canonical"), T.token_pitch(token).alias("pitch"), T.is_sung(token).alias("sung"))


@query("""SELECT event_id, d AS base, n AS dots, CASE n WHEN 0 THEN w WHEN 1 THEN w + w // 2 ELSE w + w // 2 + w // 4 END AS divisions FROM
(SELECT event_id, ['0', '1', '2', '4', '8', '16', '32', '3', '6', '12', '24'][event_id % 11 + 1] AS d, CAST(event_id % 3 AS INT) AS n,
[384, 192, 96, 48, 24, 12, 6, 64, 32, 16, 8][event_id % 11 + 1] AS w FROM events)""")
def duration(spark, sf):
    base = _pick(["0", "1", "2", "4", "8", "16", "32", "3", "6", "12", "24"], "event_id", 11)
    rows = events(spark, sf).select("event_id", T.duration(F.concat(base, F.repeat(F.lit("."), (F.col("event_id") % 3).cast("int")))).alias("x"))
    return rows.select("event_id", "x.base", "x.dots", "x.divisions")


@query("""SELECT event_id, upper(l) AS step, CASE WHEN event_id % 2 = 0 THEN 3 + n ELSE 4 - n END AS octave FROM
(SELECT event_id, substr('abcdefg', CAST(event_id % 7 + 1 AS INT), 1) AS l, CAST(event_id % 4 + 1 AS INT) AS n FROM events)""")
def pitch_step(spark, sf):
    letter = F.substr(F.lit("abcdefg"), (F.col("event_id") % 7 + 1).cast("int"), F.lit(1))
    word = F.repeat(F.when(F.col("event_id") % 2 == 0, letter).otherwise(F.upper(letter)), (F.col("event_id") % 4 + 1).cast("int"))
    return events(spark, sf).select("event_id", T.pitch_step(word).alias("x")).select("event_id", "x.step", "x.octave")


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'G' WHEN 1 THEN 'F' ELSE 'G' END AS sign, CASE event_id % 3 WHEN 1 THEN 4 ELSE 2 END AS line, CASE event_id % 3 WHEN 2 THEN -1 ELSE 0 END AS octave_change,
CASE WHEN event_id % 15 > 7 THEN -(event_id % 15 - 7) ELSE event_id % 15 END AS fifths, CAST(event_id % 12 + 1 AS INT) AS num, 8 AS den FROM events""")
def clef_key_meter(spark, sf):
    n = (F.col("event_id") % 15).cast("int")
    fifths = F.when(n > 7, 7 - n).otherwise(n)
    rows = events(spark, sf).select(
        "event_id", T.clef(_pick(["*clefG2", "*clefF4", "*clefGv2"], "event_id", 3)).alias("c"), T.key_fifths(T.key_token(fifths)).cast("long").alias("fifths"),
        T.meter(F.concat(F.lit("*M"), (F.col("event_id") % 12 + 1).cast("string"), F.lit("/8"))).alias("m"),
    )
    return rows.select("event_id", "c.sign", "c.line", F.col("c.octaveChange").alias("octave_change"), "fifths", "m.num", "m.den")


@query(f"""SELECT event_id, CASE WHEN k < 55 THEN '*clefF4' WHEN event_id % 7 + 2 = 4 AND event_id % 4 = 2 AND k < 65 THEN '*clefGv2' WHEN k < 60 THEN '*clefGv2' ELSE '*clefG2' END AS clef,
CASE WHEN event_id % 4 + 5 = 8 AND event_id % 12 + 1 > 3 AND (event_id % 12 + 1) % 3 = 0 THEN 720 WHEN event_id % 4 = 0 THEN 480 ELSE 480 END AS ticks,
['regular', 'final', 'other'][event_id % 3 + 1] AS bar FROM (SELECT event_id, {K_SQL} AS k FROM events)""")
def clef_choice(spark, sf):
    e = F.col("event_id")
    return with_k(events(spark, sf)).select(
        "event_id", T.clef_token(F.col("k"), e % 4, e % 7 + 2).alias("clef"), T.beam_group(e % 12 + 1, e % 4 + 5).alias("ticks"), T.barline_type(_pick(["=", "==", "=~"], "event_id", 3)).alias("bar")
    )


_NAMES = ["C", "F#", "Bb", "E", "B#"]


@query(f"""WITH x AS (SELECT event_id, 36 + event_id % 48 AS midi, {_sql_list(_NAMES)}[event_id % 5 + 1] AS s, [0, 6, 10, 4, 12][event_id % 5 + 1] AS pc FROM events),
y AS (SELECT *, CASE WHEN (midi - pc) % 12 = 0 THEN CAST((midi - pc) // 12 - 1 AS INT) END AS o FROM x)
SELECT event_id, CASE WHEN o IS NULL THEN NULL ELSE CASE WHEN o >= 4 THEN repeat(lower(s[1]), o - 3) ELSE repeat(s[1], 4 - o) END || CASE s[2:] WHEN '#' THEN '#' WHEN 'b' THEN '-' ELSE '' END END AS pitch FROM y""")
def spell_pitch(spark, sf):
    return events(spark, sf).select("event_id", T.spell_pitch((36 + F.col("event_id") % 48).cast("int"), _pick(_NAMES, "event_id", 5)).alias("pitch"))


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN '4' WHEN 1 THEN '4.' WHEN 2 THEN '2 8' WHEN 3 THEN '12' WHEN 4 THEN '1 8' ELSE NULL END AS codes FROM events""")
def duration_codes(spark, sf):
    length = F.get(F.array(*map(F.lit, [480, 720, 1200, 160, 2160, 96])), (F.col("event_id") % 6).cast("int"))
    return events(spark, sf).select("event_id", F.array_join(T.duration_codes(length), " ").alias("codes"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '4f#[ 2a' ELSE '4f# [2a' END AS joined FROM events")
def token_join(spark, sf):
    """The join by separators, and the older one with its known fault."""
    marked, plain = F.split(F.lit("4 f # <b> [ 2 a"), " "), F.split(F.lit("4 f # [ 2 a"), " ")
    joined = F.when(F.col("event_id") % 2 == 0, F.array_join(T.join_legacy(plain), " ")).otherwise(F.array_join(T.join_records(marked), " "))
    return events(spark, sf).select("event_id", joined.alias("joined"))


@query("SELECT doc_id, CAST(len(string_split(text, ' ')) * 2 - 1 AS BIGINT) AS n FROM documents")
def separator_interleave(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(T.with_separators(F.split("text", " "))).cast("long").alias("n"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'Ky- -ri- -e e- -lei- -son' WHEN 1 THEN 'A- -men' WHEN 2 THEN 'mei- -nes Herz' ELSE '' END AS syllables FROM events")
def syllables(spark, sf):
    text = _pick(["Ky-ri-e e-lei-son", " A-men ", "mei-nes  Herz", ""], "event_id", 4)
    return events(spark, sf).select("event_id", F.array_join(T.syllables(text), " ").alias("syllables"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN '4c <b> 8d' WHEN 1 THEN '' WHEN 2 THEN '4r <b> =' ELSE '2a' END AS tokens FROM events""")
def strip_unprinted(spark, sf):
    text = _pick(["**kern <b> 4c <b> 2ryy <b> 8d <b> *-", "<b> 4.ryy <b> *-", "4r <b> <b> = <b>", "**kern 2a *-"], "event_id", 4)
    return events(spark, sf).select("event_id", F.array_join(T.strip_unprinted(F.split(text, " ")), " ").alias("tokens"))


@query("""SELECT event_id, ['=', '==', '=||', NULL, '=:|!', '=:|!|:', '=!|:', NULL][event_id % 8 + 1] AS token FROM events""")
def barline_folding(spark, sf):
    rows = events(spark, sf).select("event_id", *[_pick(v, "event_id", 8).alias(n) for n, v in (
        ("kind", ["bar", "bar", "bar", "bar", "repeat", "repeat", "bar", "repeat"]), ("direction", ["", "", "", "", "end", "end", "", "start"]),
        ("style", ["regular", "final", "double", "dotted", "final", "final", "tick", "final"]), ("following", ["n", "n", "n", "n", "n", "y", "y", "n"]))])
    return rows.select("event_id", T.barline_token(F.struct("kind", "direction", "style"), F.col("following") == "y").alias("token"))


@query("""SELECT path, CAST(n AS INT) AS n_tracks, genre FROM (SELECT path, try_cast(n AS INT) AS n, lower(trim(coalesce(nullif(genres, ''), 'NA'))) AS genre, license, lyr, ded FROM (
SELECT 'p' || event_id AS path, ['abc', '1', '4', '8', '9'][event_id % 5 + 1] AS n, ['', ' Folk ', 'Hymn'][event_id % 3 + 1] AS genres, ['cc-zero', 'cc-by', 'publicdomain'][event_id // 3 % 3 + 1] AS license,
['True', 'true'][event_id // 7 % 2 + 1] AS lyr, ['True', 'False'][event_id // 11 % 2 + 1] AS ded FROM events))
WHERE n BETWEEN 2 AND 8 AND lyr = 'True' AND ded = 'True' AND license IN ('cc-zero', 'publicdomain')""")
def catalogue_filter(spark, sf):
    from ..sources.readers import catalogue_filter as candidates

    def part(values, step):
        return F.get(F.array(*map(F.lit, values)), (F.floor(F.col("event_id") / step) % len(values)).cast("int"))

    rows = events(spark, sf).select(
        F.concat(F.lit("p"), F.col("event_id").cast("string")).alias("path"), F.lit("t").alias("title"), F.lit("9").alias("song_length.bars"), part(["abc", "1", "4", "8", "9"], 1).alias("n_tracks"), part(["", " Folk ", "Hymn"], 1).alias("genres"),
        part(["cc-zero", "cc-by", "publicdomain"], 3).alias("license"), part(["True", "true"], 7).alias("has_lyrics"), part(["True", "False"], 11).alias("subset:deduplicated"),
    )
    return candidates(rows).select("path", "n_tracks", "genre")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)
SELECT doc_id, count(*) AS n_lines, CAST(max(line_no) AS INT) AS last_line, count(*) FILTER (WHERE raw[1] IN ('!', '*', '=')) AS n_marked FROM l WHERE trim(raw) <> '' GROUP BY doc_id""")
def kern_scan(spark, sf):
    from ..sources.readers import parse_kern

    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("value"))
    rows = parse_kern(docs).groupBy(F.col("path").alias("doc_id"))
    return rows.agg(F.count("*").alias("n_lines"), F.max("line_no").alias("last_line"), F.count_if(F.col("kind") != "data").alias("n_marked"))


def _notes(spark, sf):
    """Pieces of two voices: the events of a user, dealt to two tracks, as eighths and quarters with gaps."""
    n = F.row_number().over(notes.over(["user_id", "track"], ["event_id"])) - 1
    rows = with_k(events(spark, sf)).withColumn("track", (F.col("event_id") % 2).cast("int")).withColumn("n", n)
    return rows.select(
        F.col("user_id").alias("piece"), "track", F.col("n").alias("pos"), (480 * F.col("n")).cast("long").alias("time"), F.lit(60).alias("pitch"), F.when(F.col("k") % 3 == 0, 720).otherwise(240).cast("long").alias("raw"),
        F.lit("C").alias("spelled"), F.lit(False).alias("is_grace"),
    ).withColumn("duration", F.least("raw", F.lit(480)).cast("long"))


@query()
def notate_voices(spark, sf):
    rows = _notes(spark, sf)
    bars = rows.groupBy("piece").agg(F.max("time").alias("t")).select("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("t"), F.lit(1920).cast("long"))).alias("time"))
    meters = rows.select("piece").distinct().select("piece", F.lit(0).cast("long").alias("time"), F.lit(4).alias("num"), F.lit(4).alias("den"))
    out = notes.notate(rows, bars, meters)
    return out.groupBy("piece", "track").agg(F.sum("ticks").alias("ticks"), F.count_if("is_rest").alias("rests"), F.count_if(F.rlike("token", F.lit("L"))).alias("beams"))


@query(f"""WITH n AS (SELECT user_id AS piece, event_id % 2 AS track, event_id, {K_SQL} AS k FROM events), t AS (SELECT piece, track, count(*) AS n FROM n GROUP BY ALL), p AS (SELECT piece, min(n) AS fewest, count(*) AS tracks FROM t GROUP BY piece)
SELECT piece, CASE WHEN piece % 10 = 0 THEN 'resolution' WHEN tracks < 2 THEN 'track count' WHEN piece % 10 = 1 THEN 'no time signature' WHEN fewest < 8 THEN 'fewer than eight notes' END AS reject_reason FROM p""")
def piece_rejection(spark, sf):
    rows = _notes(spark, sf)
    pieces = rows.select("piece").distinct().select("piece", F.when(F.col("piece") % 10 == 0, 240).otherwise(480).alias("resolution"), F.when(F.col("piece") % 10 == 1, 0).otherwise(1).alias("n_meters"))
    # Five bars at least, and bars to the last note: behind the last one no rest is cut, and a long one cannot be written.
    until = F.greatest(F.max("time"), F.lit(7680)).cast("long")
    bars = rows.groupBy("piece").agg(until.alias("t")).select("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("t"), F.lit(1920).cast("long"))).alias("time"))
    return notes.piece_reasons(pieces, rows, bars)


@query()
def augmented_texts(spark, sf):
    """Each user's events as typed text of two voices, with lyrics, dynamics and harmony beside them."""
    from ..operators import augment
    from ..sources.readers import parse_kern

    token = F.when(F.col("event_type") == "error", "=").otherwise(F.concat(F.lit("4"), F.get(F.array(*map(F.lit, _LETTERS)), (F.col("k") % 7).cast("int"))))
    line = F.when(token == "=", "=\t=").otherwise(F.concat(token, F.lit("\t."))).alias("line")
    rows = with_k(events(spark, sf)).groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", line))), lambda x: x["line"]), "\n").alias("body"))
    text = rows.select(F.concat(F.lit("u"), "user_id").alias("path"), F.concat(F.lit("**kern\t**kern\n*clefF4\t*clefG2\n"), "body", F.lit("\n*-\t*-")).alias("value"))
    chosen = augment.options(text.select("path", F.lit(2).alias("n_spines")), seed="augment")
    done = augment.augment(parse_kern(text), chosen, seed="augment", syllables=[["Ky-", "ri-", "e"]])
    return done.select("path", F.size(F.split("text", "\n")).alias("n_lines"), F.size(F.split(F.element_at(F.split("text", "\n"), -1), "\t")).alias("n_fields"))
