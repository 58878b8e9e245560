"""Sources: catalogues, score documents, line metadata, typed text rows, pages, packs, name lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions.numbers import ctc_min_frames
from ..operators.gates import require_fresh


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """CSV catalogue with a header, quoted line ends and fields of up to 10 MB; every field is a string."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("maxCharsPerColumn", 10_000_000).schema(schemas.CATALOGUE).csv(path)


def catalogue_filter(rows: DataFrame, *, least: int = 2, most: int = 8, licenses: Sequence[str] = ("publicdomain", "cc-zero")) -> DataFrame:
    """Candidates: a readable number of tracks in bounds, flags that are exactly ``True``, a free license."""
    n = F.col("n_tracks").try_cast("int")
    genre = F.lower(F.trim(F.coalesce(F.nullif(F.col("genres"), F.lit("")), F.lit("NA"))))
    kept = rows.where(n.between(least, most) & (F.col("has_lyrics") == "True") & (F.col("`subset:deduplicated`") == "True") & F.col("license").isin(*licenses))
    return kept.select("path", "title", F.col("`song_length.bars`").alias("bars"), n.alias("n_tracks"), genre.alias("genre"), "license")


def score_documents(spark: SparkSession, path: str) -> DataFrame:
    """Score JSON, one document a file, with its path; drum tracks are left out."""
    docs = spark.read.schema(schemas.SCORE).option("multiLine", True).json(path).withColumn("path", F.col("_metadata.file_path"))
    return docs.withColumn("tracks", F.filter("tracks", lambda t: ~F.coalesce(t["is_drum"], F.lit(False))))


def note_rows(docs: DataFrame) -> DataFrame:
    """``piece, track, pos, time, pitch, duration, spelled, is_grace`` of score documents."""
    tracks = docs.select(F.col("path").alias("piece"), F.posexplode("tracks").alias("track", "t"))
    notes = tracks.select("piece", "track", F.posexplode("t.notes").alias("pos", "n"))
    return notes.select("piece", "track", "pos", "n.time", "n.pitch", "n.duration", F.coalesce("n.pitch_str", F.lit("")).alias("spelled"), F.coalesce("n.is_grace", F.lit(False)).alias("is_grace"))


def track_rows(docs: DataFrame) -> DataFrame:
    """``piece, track`` of all pitched tracks, those without a note too."""
    return docs.select(F.col("path").alias("piece"), F.posexplode("tracks").alias("track", "t")).select("piece", "track")


def lyric_rows(docs: DataFrame) -> DataFrame:
    """``piece, track, time, text``: trimmed, blank ones dropped, the last of a time counts."""
    tracks = docs.select(F.col("path").alias("piece"), F.posexplode("tracks").alias("track", "t"))
    rows = tracks.select("piece", "track", F.posexplode("t.lyrics").alias("pos", "l")).withColumn("text", F.trim("l.lyric")).where("text <> ''")
    return rows.groupBy("piece", "track", F.col("l.time").alias("time")).agg(F.max_by("text", "pos").alias("text"))


def json_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Metadata of lines, a file each in a folder a piece; the piece is the folder's name."""
    rows = spark.read.schema(schemas.LINE).option("multiLine", True).json(f"{folder}/*/*.json")
    path = F.col("_metadata.file_path")
    return rows.withColumns({"file": F.regexp_extract(path, r"([^/]+)$", 1), "piece": F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)})


def kern_records(spark: SparkSession, path: str) -> DataFrame:
    """Typed text rows ``path, line_no, kind, fields, raw``; blank lines are dropped but counted, line ends may be CR LF."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return parse_kern(text)


def parse_kern(text: DataFrame) -> DataFrame:
    """:func:`kern_records` of texts in column ``value`` with their ``path``."""
    lines = text.select("path", F.posexplode(F.split("value", "\n")).alias("_at", "_line"))
    raw = F.rtrim(F.col("_line"), F.lit("\r"))
    kind = (
        F.when(F.startswith("raw", F.lit("!")), "global").when(F.startswith("raw", F.lit("*")), "interp").when(F.startswith("raw", F.lit("=")), "barline").otherwise("data")
    )
    return lines.select("path", (F.col("_at") + 1).alias("line_no"), raw.alias("raw")).where("trim(raw) <> ''").select("path", "line_no", kind.alias("kind"), F.split("raw", "\t").alias("fields"), "raw")


def spine_types(records: DataFrame) -> DataFrame:
    """The fields of each text's last exclusive interpretation."""
    return records.where(F.startswith("raw", F.lit("**"))).groupBy("path").agg(F.max_by("fields", "line_no").alias("spine_types"))


def drop_labels(records: DataFrame) -> DataFrame:
    """Records that do not name an instrument."""
    return records.where(~F.startswith("raw", F.lit("*I")))


def spine_fragment(records: DataFrame, *, spine: int, start: int, end: int, header: Sequence[str] = (), closing: str | None = None, framed: bool = False) -> DataFrame:
    """One spine's tokens in a range of lines, without null tokens, behind a header and before a closing barline.

    ``framed`` tokens begin with the exclusive interpretation and end with the spine's end, as a text of their own does.
    """
    header = ["**kern", *header] if framed else header
    ends = [*([closing] if closing else []), *(["*-"] if framed else [])]
    token = F.get("fields", F.lit(spine))
    rows = records.where(F.col("line_no").between(start, end) & F.col("kind").isin("data", "barline")).where(token.isNotNull() & (token != "."))
    inside = rows.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", token.alias("t")))), lambda x: x["t"]).alias("inside"))
    return inside.select("path", F.concat(F.array(*map(F.lit, header)).cast("array<string>"), "inside", F.array(*map(F.lit, ends)).cast("array<string>")).alias("tokens"))


def raw_pages(spark: SparkSession, path: str, *, width: int) -> DataFrame:
    """Pages of raw gray bytes, row by row, of a known width: ``page, height, width, gray``."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.xxhash64("path").alias("page"), (F.col("length") / width).cast("int").alias("height"), F.lit(width).alias("width"), F.col("content").alias("gray"))


def image_pages(spark: SparkSession, path: str) -> DataFrame:
    """PNG or JPEG pages by Spark's image source, as gray: transparent parts white, then the luma of the colours."""
    image = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")

    def run(batches):
        import numpy as np
        import pandas as pd

        for batch in batches:
            out = []
            for r in batch.itertuples():
                px = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels).astype(np.float32)
                if r.nChannels == 4:
                    alpha = px[..., 3:] / 255
                    px = px[..., :3] * alpha + 255 * (1 - alpha)
                # Channels come as blue, green, red; a single one is gray already.
                gray = px[..., 0] if px.shape[2] == 1 else px[..., :3] @ np.array([0.114, 0.587, 0.299], np.float32)
                out.append((r.origin, r.height, r.width, (gray + 0.5).astype(np.uint8).tobytes()))
            yield pd.DataFrame(out, columns=["origin", "height", "width", "gray"])

    pages = image.select("origin", "height", "width", "nChannels", "data").mapInPandas(run, "origin string, height int, width int, gray binary")
    return pages.select(F.xxhash64("origin").alias("page"), "height", "width", "gray")


def pack(spark: SparkSession, path: str, *, pieces: DataFrame | None = None, source: DataFrame | None = None, made_from: int | None = None, allow_partial: bool = False) -> DataFrame:
    """Packed lines, of some pieces only; refused if they were made from another number of lines than the source has."""
    if source is not None and made_from is not None:
        require_fresh(source, made_from, allow_partial=allow_partial)
    rows = spark.read.parquet(path)
    return rows if pieces is None else rows.join(pieces.select("piece").distinct(), "piece", "left_semi")


def sample_kinds(lines: DataFrame, *, most_width: Column | int, frame: int = 4) -> DataFrame:
    """``lines`` with ``kind``: ok, too_wide, or target_longer_than_frames; too wide is told first."""
    frames = F.floor(F.col("width") / frame)
    kind = F.when(F.col("width") > most_width, "too_wide").when(frames < ctc_min_frames(F.col("tokens")), "target_longer_than_frames").otherwise("ok")
    return lines.withColumn("kind", kind)


def svg_systems(spark: SparkSession, path: str) -> DataFrame:
    """Systems of SVG pages in reading order: ``path, system, y, starts, staves``.

    ``starts`` are the source lines of the measures, from ids with ``-L<line>``; ``staves`` those of the first measure
    with a field in their id (``-L<line>F<field>``), from the top: ``field, y, clef, key, meter``, the last three telling
    what is drawn on them. Systems without such a staff are left out.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")

    def run(batches):
        import re
        import xml.etree.ElementTree as ET

        import pandas as pd

        source, height = re.compile(r"-L(\d+)(?:F(\d+))?"), re.compile(r"[ML]\s*-?\d+\s+(-?\d+)")

        def groups(node, kind):
            return [g for g in node.iter("{http://www.w3.org/2000/svg}g") if kind in (g.get("class") or "").split()]

        def top(node):
            return min((float(y) for p in node.iter("{http://www.w3.org/2000/svg}path") for y in height.findall(p.get("d") or "")), default=0.0)

        def origin(node):
            return source.search(node.get("id") or "")

        for batch in batches:
            rows = []
            for name, text in zip(batch.path, batch.value):
                for system in groups(ET.fromstring(text), "system"):
                    measures = groups(system, "measure")
                    lines = sorted({int(m[1]) for m in map(origin, measures) if m})
                    drawn = [(g, origin(g)) for m in measures[:1] for g in groups(m, "staff")]
                    staves = sorted((top(g), int(m[2]), *(bool(groups(g, k)) for k in ("clef", "keySig", "meterSig"))) for g, m in drawn if m and m[2])
                    if staves:
                        rows.append((name, staves[0][0], lines, [{"field": f, "y": y, "clef": c, "key": k, "meter": t} for y, f, c, k, t in staves]))
            yield pd.DataFrame(rows, columns=["path", "y", "starts", "staves"])

    found = files.mapInPandas(run, "path string, y double, starts array<int>, staves array<struct<field:int,y:double,clef:boolean,key:boolean,meter:boolean>>")
    return found.withColumn("system", F.row_number().over(Window.partitionBy("path").orderBy("y")) - 1).select("path", "system", "y", "starts", "staves")


def system_ranges(systems: DataFrame, records: DataFrame) -> DataFrame:
    """``path, system, start, end, closing``: the source lines of each system, in order, and the barline that closes it.

    ``systems`` has path, ``system``, ``starts``. A system begins with its first measure, but not before the first data or
    barline, and ends before the next one begins, the last with the last such line; the barline that the next one
    begins with closes it.
    """
    content = records.where(F.col("kind").isin("data", "barline"))
    span = content.groupBy("path").agg(F.min("line_no").alias("_first"), F.max("line_no").alias("_last"))
    begun = systems.join(span, "path").withColumn("start", F.greatest(F.array_min("starts"), F.col("_first")))
    following = F.lead("start").over(Window.partitionBy("path").orderBy("system"))
    ranges = begun.withColumn("_next", following).withColumn("end", F.coalesce(F.col("_next") - 1, F.col("_last")))
    bars = records.where("kind = 'barline'").select("path", F.col("line_no").alias("_next"), F.get("fields", F.lit(0)).alias("closing"))
    return ranges.join(bars, ["path", "_next"], "left").select("path", "system", "start", "end", "closing")


def xml_systems(spark: SparkSession, path: str) -> DataFrame:
    """``element, page, y, system`` of position files; a new system begins where page or height changes."""
    from ..operators.sequence import run_id

    rows = spark.read.format("xml").option("rowTag", "element").schema("_id int, _page int, _y double").load(path)
    named = rows.select(F.col("_metadata.file_path").alias("path"), F.col("_id").alias("element"), F.col("_page").alias("page"), F.bround("_y", 1).alias("y"))
    return run_id(named, keys=["path"], order=["element"], by=["page", "y"], name="system")


def name_list(spark: SparkSession, path: str, *, field: str = "piece") -> DataFrame:
    """Names from a JSON list whose entries are strings or objects with the name in a field."""
    text = spark.read.text(path, wholetext=True)
    entries = text.select(F.explode(F.from_json("value", "array<string>")).alias("entry"))
    return entries.select(F.coalesce(F.get_json_object("entry", f"$.{field}"), F.col("entry")).alias(field)).distinct()


def vocabulary_file(spark: SparkSession, path: str) -> DataFrame:
    """``token, id`` (from 1) of a JSON list of tokens."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.posexplode(F.from_json("value", "array<string>")).alias("at", "token")).select("token", (F.col("at") + 1).cast("long").alias("id"))


def evaluation_sets(**sets: DataFrame) -> DataFrame:
    """Several sets as one, told apart by ``set_name``."""
    out = None
    for name, df in sets.items():
        part = df.withColumn("set_name", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
