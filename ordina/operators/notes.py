"""From note events (ticks) to notated voices and typed texts: rests, notes split at bars and tied, beams, aligned lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tokens as T
from . import gates
from .aggregates import upper_median
from .joins import asof_inclusive, split_at
from .sequence import beam_marks, over

RESOLUTION = 480


def unique_notes(notes: DataFrame) -> DataFrame:
    """Notes ``piece, track, pos, time, pitch, duration, spelled, is_grace``: the first of equal time, pitch and duration."""
    n = F.row_number().over(Window.partitionBy("piece", "track", "time", "pitch", "duration").orderBy("pos"))
    return notes.withColumn("_n", n).where("_n = 1").drop("_n")


def slots(notes: DataFrame) -> DataFrame:
    """``piece, track, slot, median, n``: tracks from the lowest to the highest upper median, slots from 0."""
    medians = unique_notes(notes).groupBy("piece", "track").agg(upper_median("pitch").cast("int").alias("median"))
    n = F.count("*").over(Window.partitionBy("piece"))
    return medians.select("piece", "track", (F.row_number().over(over(["piece"], ["median", "track"])) - 1).alias("slot"), "median", n.cast("int").alias("n"))


def piece_reasons(pieces: DataFrame, notes: DataFrame, bars: DataFrame, tracks: DataFrame | None = None) -> DataFrame:
    """Why a piece cannot be converted, by the first check that fails; null if it can.

    ``pieces`` has ``piece, resolution, n_meters``; ``bars`` has ``piece, time``; ``tracks`` has ``piece, track`` of all pitched
    tracks, those without a note too (without it, of those with one). Within the notes the checks go track by track: a
    track's grace notes are found before its overlaps, and an earlier track's faults before a later one's. Pitches
    and lengths that cannot be written come last, voice by voice from the lowest.
    """
    distinct = unique_notes(notes)
    following = F.lead("time").over(over(["piece", "track"], ["time", "pitch"]))
    sounding = distinct.withColumn("_hit", following < F.col("time") + F.col("duration"))
    per_track = sounding.groupBy("piece", "track").agg(F.max("is_grace").alias("grace"), F.max(F.coalesce("_hit", F.lit(False))).alias("overlap"), upper_median("pitch").alias("median"), F.count("*").alias("n"), F.max(F.col("time") + F.col("duration")).alias("until"))
    if tracks is not None:
        per_track = tracks.select("piece", "track").distinct().join(per_track, ["piece", "track"], "left").na.fill(0, ["n"])
    fault = F.when(F.col("grace"), "grace notes").when(F.col("overlap"), "two notes sound at once")
    by_piece = per_track.withColumn("_fault", fault).groupBy("piece").agg(
        F.count("*").alias("n_tracks"), F.min_by("_fault", F.when(F.col("_fault").isNotNull(), F.col("track"))).alias("fault"), F.min("n").alias("fewest"), F.min("median").alias("lowest"), F.max("until").alias("until")
    )
    n_bars = bars.groupBy("piece").agg(F.count_distinct("time").alias("n_bars"), F.min("time").alias("first_bar"))
    what = F.when(F.col("name").isNull(), "spelling").when(F.col("codes").isNull(), "length")
    unwritten = _cut_events(notes, bars, RESOLUTION).withColumn("_what", what).where("_what is not null").join(slots(notes), ["piece", "track"])
    unwritten = unwritten.groupBy("piece").agg(F.min_by("_what", F.struct("slot", "whole", F.col("_what") == "length")).alias("unwritten"))
    joined = pieces.join(by_piece, "piece", "left").join(n_bars, "piece", "left").join(unwritten, "piece", "left").na.fill(0, ["n_tracks", "n_bars"])
    checks = [
        (~F.col("resolution").eqNullSafe(F.lit(RESOLUTION)), "resolution"),
        (~F.col("n_tracks").between(2, 8), "track count"),
        (F.col("n_meters") == 0, "no time signature"),
        (F.col("n_bars") < 4, "fewer than four barlines"),
        (F.col("fault").isNotNull(), "fault"),
        (F.col("fewest") < 8, "fewer than eight notes"),
        (F.col("until") <= F.col("first_bar"), "no music after the first bar"),
        ((F.col("n_tracks") >= 3) & (F.col("lowest") > 67), "no low voice"),
        (F.col("unwritten").isNotNull(), "unwritten"),
    ]
    reason = gates.first_reason(checks)
    return joined.select("piece", F.when(reason == "fault", F.col("fault")).when(reason == "unwritten", F.col("unwritten")).otherwise(reason).alias("reject_reason"))


def _cut_events(notes: DataFrame, bars: DataFrame, resolution: int) -> DataFrame:
    """Notes and the rests between them, cut at bars, with the codes of their lengths: ``piece, track, whole, start, end,
    name, is_rest, codes``; null names and codes cannot be written."""
    voices = unique_notes(notes).select("piece", "track", F.col("time").alias("start"), (F.col("time") + F.col("duration")).alias("end"), T.spell_pitch(F.col("pitch"), F.col("spelled")).alias("name"))
    frame = bars.groupBy("piece").agg(F.min("time").alias("origin")).join(voices.groupBy("piece").agg(F.max("end").alias("until")), "piece")
    kept = voices.join(frame, "piece").where("start >= origin").withColumn("is_rest", F.lit(False))
    before = F.coalesce(F.lag("end").over(over(["piece", "track"], ["start"])), F.col("origin"))
    gaps = kept.withColumn("_before", before).where("start > _before").select("piece", "track", F.col("_before").alias("start"), F.col("start").alias("end"))
    tails = kept.groupBy("piece", "track", "until").agg(F.max("end").alias("start")).where("start < until").select("piece", "track", "start", F.col("until").alias("end"))
    rests = gaps.unionByName(tails).select("*", F.lit("r").alias("name"), F.lit(True).alias("is_rest"))
    events = kept.select("piece", "track", "start", "end", "name", "is_rest").unionByName(rests)
    cut = split_at(events.withColumn("whole", F.col("start")), bars, keys=["piece"], start="start", end="end", bound="time", width=4 * resolution, number="part")
    return cut.withColumn("codes", T.duration_codes(F.col("end") - F.col("start"), resolution))


def notate(notes: DataFrame, bars: DataFrame, meters: DataFrame, *, resolution: int = RESOLUTION) -> DataFrame:
    """Tokens of each voice: ``piece, track, time, ticks, token, is_rest``.

    Notes keep their spelling, rests fill the gaps from the first bar to the piece's end, both are cut at bars and into
    writable lengths; pieces of one note are tied, short notes within a beat of the bar are beamed. ``meters`` has the
    ``piece``'s ``time, num, den``; the first one tells the beats. Pieces with a pitch or a length that cannot be written
    have null tokens.
    """
    coded = _cut_events(notes, bars, resolution)
    rows = coded.select("piece", "track", "whole", F.col("start").alias("piece_start"), "name", "is_rest", F.posexplode_outer("codes").alias("j", "code"))
    rows = rows.withColumn("ticks", (T.ticks(F.col("code"), 4 * 8 * resolution) / 8).cast("long"))
    inner = Window.partitionBy("piece", "track", "whole", "is_rest").orderBy("piece_start", "j")
    n, size = F.row_number().over(inner), F.count("*").over(Window.partitionBy("piece", "track", "whole", "is_rest"))
    offset = F.coalesce(F.sum("ticks").over(Window.partitionBy("piece", "track", "piece_start", "is_rest").orderBy("j").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tied = F.when(F.col("is_rest") | (size == 1), "").when(n == 1, "[").when(n == size, "]").otherwise("_")
    placed = rows.withColumns({"_tie": tied, "time": F.col("piece_start") + offset})

    # The bar of a place is the last that began by then: carried forward, not looked up in a list of all.
    starts = bars.select("piece", "time", F.col("time").alias("_start"))
    width = meters.groupBy("piece").agg(F.min_by(T.beam_group(F.col("num"), F.col("den"), resolution), "time").alias("_width"))
    first = bars.groupBy("piece").agg(F.min("time").alias("_origin"))
    placed = asof_inclusive(placed, starts, keys=["piece"], left_time="time", right_time="time", value="_start", name="bar").join(first, "piece").join(width, "piece", "left")
    beat = F.floor((F.col("time") - F.coalesce("bar", "_origin")) / F.coalesce("_width", F.lit(resolution)))
    beamed = beam_marks(placed.withColumn("_group", beat), keys=["piece", "track"], order=["time"], group=["bar", "_group"], beamable=~F.col("is_rest") & (F.col("ticks") * 2 <= resolution))
    opening = F.when(F.col("_tie") == "[", "[").otherwise("")
    closing = F.when(F.col("_tie").isin("]", "_"), F.col("_tie")).otherwise("")
    return beamed.select("piece", "track", "time", "ticks", F.concat(opening, "code", "name", "beam", closing).alias("token"), "is_rest")


def to_kern(notes: DataFrame, bars: DataFrame, meters: DataFrame, keys: DataFrame | None = None, *, resolution: int = RESOLUTION) -> DataFrame:
    """Typed texts ``piece, text``: a column a voice from the lowest up, a row a time.

    Clefs, key signature and meter stand above, numbered barlines and later meters before the notes of their time, a
    final barline and the columns' ends below. ``keys`` has ``piece, fifths``. Pieces should have passed :func:`piece_reasons`.
    """
    voices = slots(notes)
    size = voices.groupBy("piece").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("slot", T.clef_token(F.col("median"), F.col("n") - 1 - F.col("slot"), F.col("n")).alias("clef")))), lambda x: x["clef"]).alias("clefs"))
    origin = bars.groupBy("piece").agg(F.min("time").alias("origin"))
    whole = size.join(origin, "piece")
    changes = meters.groupBy("piece", "time").agg(F.max(F.struct("num", "den")).alias("m")).select("piece", "time", F.format_string("*M%d/%d", "m.num", "m.den").alias("meter"))
    first = changes.groupBy("piece").agg(F.min_by("meter", "time").alias("meter"), F.min("time").alias("since"))
    whole = whole.join(first, "piece", "left")
    whole = whole.join(keys.groupBy("piece").agg(F.first("fifths").alias("fifths")), "piece", "left") if keys is not None else whole.withColumn("fifths", F.lit(0))

    def across(token: Column) -> Column:
        return F.array_join(F.array_repeat(token, F.col("n")), "\t")

    def rows(df: DataFrame, part: int, time: Column, rank: int, text: Column) -> DataFrame:
        return df.select("piece", F.struct(F.lit(part).alias("part"), time.cast("long").alias("time"), F.lit(rank).alias("rank"), text.alias("text")).alias("row"))

    zero = F.lit(0)
    head = [across(F.lit("**kern")), F.array_join("clefs", "\t"), across(T.key_token(F.col("fifths"))), across(F.col("meter"))]
    lines = [rows(whole, 0, zero, i, text) for i, text in enumerate(head)] + [rows(whole, 2, zero, i, across(F.lit(x))) for i, x in enumerate(("==", "*-"))]
    number = F.row_number().over(over(["piece"], ["time"]))
    lines.append(rows(bars.select("piece", "time").distinct().withColumn("_k", number).join(whole, "piece").where("time <> origin"), 1, F.col("time"), 0, across(F.format_string("=%d", "_k"))))
    later = changes.withColumnRenamed("meter", "_meter").join(whole, "piece").where("time <> since and time >= origin")
    lines.append(rows(later, 1, F.col("time"), 1, across(F.col("_meter"))))
    cells = notate(notes, bars, meters, resolution=resolution).join(voices.drop("n"), ["piece", "track"]).groupBy("piece", "time", "slot").agg(F.max_by("token", "ticks").alias("token"))
    at_once = cells.groupBy("piece", "time").agg(F.map_from_entries(F.collect_list(F.struct("slot", "token"))).alias("cells")).join(whole, "piece")
    text = F.array_join(F.transform(F.sequence(zero, F.col("n") - 1), lambda i: F.coalesce(F.element_at("cells", i), F.lit("."))), "\t")
    lines.append(rows(at_once, 1, F.col("time"), 2, text))
    out = lines[0]
    for part in lines[1:]:
        out = out.unionByName(part)
    return out.groupBy("piece").agg(F.array_join(F.transform(F.array_sort(F.collect_list("row")), lambda r: r["text"]), "\n").alias("text"))
