"""Sinks: texts by piece, packs with offsets, documents, summaries, idempotent appends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def write_pieces(rows: DataFrame, path: str, *, piece: str = "piece", text: str = "text") -> None:
    """One folder of text a piece; pieces that are written again replace what was there."""
    rows.select(piece, text).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(piece).text(path)


def line_name(system: str, voice: str):
    """Names that sort as they are numbered."""
    return F.format_string("s%03dv%d", system, voice)


def with_offsets(lines: DataFrame, *, size: str, order: Sequence[str]) -> DataFrame:
    """``lines`` with their byte offsets in a file of all lines of a piece."""
    before = Window.partitionBy("piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("offset", F.coalesce(F.sum(size).over(before), F.lit(0)).cast("long"))


def write_pack(lines: DataFrame, path: str, *, height: int, order: Sequence[str]) -> int:
    """Write lines ordered by piece with offsets; returns how many, for the freshness check of the reader."""
    sized = with_offsets(lines.withColumn("_size", F.col("width") * F.lit(height)), size="_size", order=order).drop("_size")
    sized.repartition("piece").sortWithinPartitions("piece", *order).write.mode("overwrite").parquet(path)
    return lines.sparkSession.read.parquet(path).count()


def write_documents(docs: DataFrame, path: str, *, document: str = "document") -> None:
    docs.select(F.col(document).alias("value")).write.mode("overwrite").text(path)


def write_summary(row: DataFrame, path: str) -> None:
    """A one-row aggregate as JSON."""
    row.coalesce(1).write.mode("overwrite").json(path)


def write_append_new(rows: DataFrame, path: str, *, key: Sequence[str]) -> None:
    """Append the rows whose key the table does not hold yet, so that a restarted run adds nothing twice."""
    spark = rows.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        rows = rows.join(spark.read.parquet(path).select(*key).distinct(), list(key), "left_anti")
    rows.write.mode("append").parquet(path)


def write_fixtures(lines: DataFrame, path: str, *, order: Sequence[str], k: int = 24) -> int:
    """Write ``k`` lines at equal distances in order as fixtures; returns how many there are."""
    from ..operators.sampling import evenly_spaced

    evenly_spaced(lines, order=order, k=k).coalesce(1).write.mode("overwrite").parquet(path)
    return lines.sparkSession.read.parquet(path).count()


def write_merged(new: DataFrame, path: str, *, key: Sequence[str]) -> None:
    """Results with new ones in the place of old ones of the same key; written beside the old ones before these go."""
    from ..tables import discard, materialise

    spark = new.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    whole = materialise(merge_results(spark.read.parquet(path), new, key=key) if exists else new, "merged")
    whole.write.mode("overwrite").parquet(path)
    discard(whole)


def merge_results(old: DataFrame, new: DataFrame, *, key: Sequence[str]) -> DataFrame:
    """Old results with those replaced for which there are new ones."""
    return old.join(new.select(*key).distinct(), list(key), "left_anti").unionByName(new, allowMissingColumns=True)
