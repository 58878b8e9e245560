"""From decoded token events to score documents."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructType

from ..functions import tokens as T

EVENT_TYPE = StructType().add("token", StringType()).add("f0", IntegerType()).add("f1", IntegerType()).add("confidence", DoubleType())
EVENT = "struct<token:string,f0:int,f1:int,confidence:double>"
#: Fixed pairs of neighbouring barlines that stand for printed empty bars.
KEPT_PAIRS = (("=", "="), ("=", "=="))


def collapse_barline_records(records: list[list[dict]]) -> list[list[dict]]:
    """Merge neighbouring barline records other than the kept pairs.

    Of two, the more specific token stays and covers the frames of both; what a merge leaves is compared with its left
    neighbour again.
    """
    stack: list[list[dict]] = []
    for record in records:
        now = record
        while stack:
            left, right = stack[-1][0], now[0]
            bars = left["token"].startswith("=") and right["token"].startswith("=")
            if not bars or (left["token"], right["token"]) in KEPT_PAIRS:
                break
            before = stack.pop()
            frames = {"f0": min(left["f0"], right["f0"]), "f1": max(before[-1]["f1"], now[-1]["f1"])}
            stays = now if left["token"] == "=" and right["token"] != "=" else before
            now = [{**stays[0], **frames}, *stays[1:]]
        stack.append(now)
    return stack


@F.arrow_udf(ArrayType(ArrayType(EVENT_TYPE)))
def collapse_barlines(lines: pa.Array) -> pa.Array:
    """:func:`collapse_barline_records` over a column of record arrays; a fold that no window can express."""
    event = pa.struct([("token", pa.string()), ("f0", pa.int32()), ("f1", pa.int32()), ("confidence", pa.float64())])
    return pa.array([collapse_barline_records(line) if line is not None else None for line in lines.to_pylist()], pa.list_(pa.list_(event)))


def records_of(events: Column, separator: str = "<b>") -> Column:
    """Events between separators as arrays; empty records are dropped."""
    empty = F.expr(f"cast(array() as array<array<{EVENT}>>)")
    zero = F.struct(empty.alias("done"), F.expr(f"cast(array() as array<{EVENT}>)").alias("now"))

    def close(s: Column) -> Column:
        return F.when(F.size(s["now"]) > 0, F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"])

    def add(s: Column, e: Column) -> Column:
        blank = F.expr(f"cast(array() as array<{EVENT}>)")
        return F.when(e["token"] == separator, F.struct(close(s).alias("done"), blank.alias("now"))).otherwise(F.struct(s["done"].alias("done"), F.concat(s["now"], F.array(e)).alias("now")))

    return F.aggregate(events, zero, add, close)


def classify(record: Column) -> Column:
    """A record as one element of kind barline, attribute, note, rest or unparseable; null for an unknown interpretation."""
    names = F.transform(record, lambda e: e["token"])
    first = F.get(names, F.lit(0))
    lengths = F.filter(F.transform(names, T.duration), lambda d: d.isNotNull())
    pitches = F.filter(F.transform(names, T.pitch_step), lambda p: p.isNotNull())
    is_rest = F.array_contains(names, "r")
    kind = (
        F.when(F.startswith(first, F.lit("=")), "barline")
        .when(F.rlike(first, F.lit(r"^\*(clef|k\[|M\d+/)")), "attribute")
        .when(F.startswith(first, F.lit("*")), F.lit(None))
        .when(F.size(lengths) == 0, "unparseable")
        .when(is_rest, "rest")
        .when(F.size(pitches) == 0, "unparseable")
        .otherwise("note")
    )
    note, sounding = kind == "note", kind.isin("note", "rest")
    tie = F.when(F.array_contains(names, "["), "start").when(F.array_contains(names, "]"), "stop").when(F.array_contains(names, "_"), "continue")
    slur = F.when(F.array_contains(names, "("), "start").when(F.array_contains(names, ")"), "stop")
    element = F.struct(
        kind.alias("kind"),
        F.array_min(F.transform(record, lambda e: e["confidence"])).alias("confidence"),
        names.alias("tokens"),
        F.when(kind == "barline", T.barline_type(first)).alias("type"),
        T.clef(first).alias("clef"),
        T.key_fifths(first).alias("keyFifths"),
        T.meter(first).alias("time"),
        F.when(sounding, F.get(lengths, F.lit(0))).alias("duration"),
        F.when(note, F.struct(F.get(pitches, F.lit(0))["step"].alias("step"), F.get(pitches, F.lit(0))["octave"].alias("octave"), T.alter(names).alias("alter"))).alias("pitch"),
        F.when(note, tie).alias("tie"),
        F.when(note, slur).alias("slur"),
        F.when(note, F.array_contains(names, ";")).alias("fermata"),
        F.array_min(F.transform(record, lambda e: e["f0"])).alias("f0"),
        F.array_max(F.transform(record, lambda e: e["f1"])).alias("f1"),
    )
    return F.when(kind.isNotNull(), element)


def line_elements(lines: DataFrame, events: str = "events") -> DataFrame:
    """``lines`` with ``elements``: segmented, barlines collapsed, classified, unknown ones dropped."""
    with_records = lines.withColumn("_records", collapse_barlines(records_of(F.col(events))))
    return with_records.withColumn("elements", F.filter(F.transform("_records", classify), lambda e: e.isNotNull())).drop("_records")


def assemble(lines: DataFrame, verdicts: DataFrame | None = None) -> dict[str, DataFrame]:
    """Score documents from lines ``score, page, system, staff, truncated, elements``, staves from 0 in reading order.

    Returns ``structure`` (a row a score: staves per system, the most frequent number, ties the larger; first key and
    meter in reading order), ``clefs`` (first of each part), ``measures`` (score, part, measure, system it was opened
    in, events, attributes, barline) and ``warnings`` in order. Attributes and notes open a measure, a barline closes
    it, one without an open measure is dropped. Lines beyond the usual number of staves are warned of and left out.
    ``systems`` (boxes of systems and their staves) is there if lines have ``x, y, w, h, spacing, norm_spacing``.

    ``verdicts`` has ``score, rejected, reason, modal_staves, codes``: its codes come first among the warnings, and a number
    of staves other than that of the lines is warned of.
    """
    counts = lines.groupBy("score", "page", "system").agg((F.max("staff") + 1).alias("found"))
    tally = counts.groupBy("score", "found").agg(F.count("*").alias("n"))
    usual = tally.groupBy("score").agg(F.max(F.struct("n", "found")).alias("best")).select("score", F.col("best.found").alias("staves"))
    joined = lines.join(usual, "score")
    rows = joined.select("score", "page", "system", "staff", "staves", "truncated", F.posexplode_outer("elements").alias("at", "e"))
    place = ["page", "system", "staff", "at"]
    kept = rows.where("staff < staves and e is not null and e.kind <> 'unparseable'")

    first = kept.withColumn("_p", F.struct(*place))
    structure = usual.join(
        first.groupBy("score").agg(F.min_by("e.keyFifths", F.when(F.col("e.keyFifths").isNotNull(), F.col("_p"))).alias("key_fifths"), F.min_by("e.time", F.when(F.col("e.time").isNotNull(), F.col("_p"))).alias("time")),
        "score",
        "left",
    )
    clefs = first.where("e.clef is not null").groupBy("score", "staff").agg(F.min_by("e.clef", "_p").alias("clef"))

    walk = Window.partitionBy("score", "staff").orderBy("page", "system", "at")
    bar = F.col("e.kind") == "barline"
    closed = F.coalesce(F.sum(bar.cast("int")).over(walk.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    grouped = (
        kept.withColumns({"_closed": closed, "_n": F.row_number().over(walk), "_bar": bar})
        .groupBy("score", "staff", "_closed")
        .agg(
            F.count_if(~F.col("_bar")).alias("content"),
            F.min_by("system", F.when(~F.col("_bar"), F.col("_n"))).alias("system"),
            F.transform(F.array_sort(F.collect_list(F.when(F.col("e.kind").isin("note", "rest"), F.struct("_n", "e")))), lambda x: x["e"]).alias("events"),
            F.max_by("e.clef", F.when(F.col("e.clef").isNotNull(), F.col("_n"))).alias("clef"),
            F.max_by("e.keyFifths", F.when(F.col("e.keyFifths").isNotNull(), F.col("_n"))).alias("key_fifths"),
            F.max_by("e.time", F.when(F.col("e.time").isNotNull(), F.col("_n"))).alias("time"),
            F.max(F.when(F.col("_bar"), F.struct("e.type", "e.confidence", "e.tokens", "e.f0", "e.f1"))).alias("barline"),
        )
        .where("content > 0")
    )
    number = F.row_number().over(Window.partitionBy("score", "staff").orderBy("_closed")) - 1
    measures = grouped.withColumn("measure", number).drop("_closed", "content")

    uneven = counts.join(usual, "score").where("found <> staves").select(
        "score", F.lit(1).alias("seq"), F.lit("staff-count-mismatch").alias("code"), "page", "system", F.lit(None).cast("int").alias("staff"), F.lit(None).cast("int").alias("at"),
        "found", F.col("staves").alias("expected"), F.lit(None).cast("array<string>").alias("tokens"),
    )
    none = F.lit(None).cast("int")
    cut = joined.where("truncated").select("score", F.lit(2).alias("seq"), F.lit("line-truncated").alias("code"), "page", "system", "staff", F.lit(-1).alias("at"), none.alias("found"), none.alias("expected"), F.lit(None).cast("array<string>").alias("tokens"))
    bad = rows.where("staff < staves and e.kind = 'unparseable'").select("score", F.lit(2).alias("seq"), F.lit("unparseable-tokens").alias("code"), "page", "system", "staff", "at", none.alias("found"), none.alias("expected"), F.col("e.tokens").alias("tokens"))
    warnings = uneven.unionByName(cut).unionByName(bad)
    out = {"structure": structure, "clefs": clefs, "measures": measures, "warnings": warnings}
    if verdicts is not None:
        nothing = [none.alias(c) for c in ("page", "system", "staff")]
        given = verdicts.select("score", F.lit(-1).alias("seq"), F.posexplode("codes").alias("at", "code"), *nothing, none.alias("found"), none.alias("expected"), F.lit(None).cast("array<string>").alias("tokens"))
        other = verdicts.join(usual, "score").where("modal_staves <> staves").select(
            "score", F.lit(0).alias("seq"), F.lit("modal-staves-disagreement").alias("code"), *nothing, none.alias("at"), F.col("staves").alias("found"), F.col("modal_staves").cast("int").alias("expected"), F.lit(None).cast("array<string>").alias("tokens")
        )
        out |= {"warnings": warnings.unionByName(given).unionByName(other), "verdicts": verdicts}
    if {"x", "y", "w", "h", "spacing", "norm_spacing"} <= set(lines.columns):
        out["systems"] = systems_of(lines)
    return out


def systems_of(lines: DataFrame) -> DataFrame:
    """``score, page, system, box, staves``: the box around each system's staves, and these from the top."""
    box = F.array("x", "y", "w", "h")
    staff = F.struct("y", F.col("staff").alias("part"), box.alias("bbox"), F.col("spacing").alias("lineSpacingPx"), F.bround(F.col("spacing") / F.col("norm_spacing"), 4).alias("normScale"))
    joint = F.array(F.min("x"), F.min("y"), F.max(F.col("x") + F.col("w")) - F.min("x"), F.max(F.col("y") + F.col("h")) - F.min("y"))
    staves = F.transform(F.array_sort(F.collect_list(staff)), lambda s: F.struct(s["part"].alias("part"), s["bbox"].alias("bbox"), s["lineSpacingPx"].alias("lineSpacingPx"), s["normScale"].alias("normScale")))
    return lines.groupBy("score", "page", "system").agg(joint.alias("box"), staves.alias("staves"))


def to_documents(assembled: dict[str, DataFrame], *, model: str = "", decoder: str = "", pages: DataFrame | None = None) -> DataFrame:
    """One JSON document a score: all fields of the format, of which absent ones are left out; warnings in order.

    ``pages`` has ``score, pages`` (what the document's source tells of its pages).
    """
    structure, clefs = assembled["structure"], assembled["clefs"]
    name = F.concat(F.col("clef.sign"), F.col("clef.line").cast("string"), F.when(F.col("clef.octaveChange") < 0, "v8").otherwise(""))
    by_part = clefs.groupBy("score").agg(F.map_from_entries(F.collect_list(F.struct("staff", name))).alias("_clefs"))
    every = F.sequence(F.lit(0), F.col("staves") - 1)
    attributes = F.when(F.coalesce(F.col("clef").isNotNull() | F.col("key_fifths").isNotNull() | F.col("time").isNotNull(), F.lit(False)), F.struct("clef", F.col("key_fifths").alias("keyFifths"), "time"))
    measure = F.struct(F.col("measure").alias("index"), "system", "events", attributes.alias("attributes"), "barline")
    parts = assembled["measures"].groupBy("score", "staff").agg(F.array_sort(F.collect_list(F.struct("measure", measure.alias("m")))).alias("ms"))
    parts = parts.groupBy("score").agg(F.map_from_entries(F.collect_list(F.struct("staff", F.transform("ms", lambda x: x["m"])))).alias("_parts"))
    warning = F.struct("seq", "page", "system", "staff", "at", "code", "found", "expected", "tokens")
    warnings = assembled["warnings"].groupBy("score").agg(F.array_sort(F.collect_list(warning)).alias("_warnings"))
    whole = structure.join(by_part, "score", "left").join(parts, "score", "left").join(warnings, "score", "left")

    def more(df: DataFrame | None, fields: dict[str, str]) -> DataFrame:
        return whole.join(df, "score", "left") if df is not None else whole.withColumns({k: F.lit(None).cast(t) for k, t in fields.items()})

    whole = more(assembled["verdicts"].select("score", "rejected", "reason") if "verdicts" in assembled else None, {"rejected": "boolean", "reason": "string"})
    systems = assembled.get("systems")
    if systems is not None:
        systems = systems.groupBy("score").agg(F.array_sort(F.collect_list(F.struct("page", F.col("system").alias("index"), F.col("box").alias("bbox"), "staves"))).alias("_systems"))
    whole = more(systems, {"_systems": "array<string>"})
    whole = more(pages, {"pages": "string"})
    recognized = F.struct(F.col("staves").alias("stavesPerSystem"), F.transform(every, lambda i: F.element_at("_clefs", i)).alias("clefs"), F.col("key_fifths").alias("keyFifths"), "time")
    none = F.array().cast("array<string>")
    document = F.struct(
        F.lit("1.3").alias("irVersion"),
        F.struct(F.lit(model).alias("model"), F.lit(decoder).alias("decoder")).alias("generator"),
        F.coalesce("rejected", F.lit(False)).alias("rejected"),
        F.col("reason").alias("rejectionReason"),
        F.struct("pages").alias("source"),
        F.struct(recognized.alias("recognized"), F.lit(None).cast("string").alias("confirmed")).alias("structure"),
        F.coalesce("_systems", none if systems is None else F.slice("_systems", 1, 0)).alias("systems"),
        F.transform(every, lambda i: F.struct(i.alias("index"), F.lit(None).cast("string").alias("label"), F.element_at("_parts", i).alias("measures"))).alias("parts"),
        F.transform("_warnings", lambda w: w.dropFields("seq", "at")).alias("warnings"),
    )
    return whole.select("score", F.to_json(document).alias("document"))
