"""Which reader takes a file, and the peaks of those that aren't plain tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.functions import text as T
from tallyloom.functions.shared import cut
from tallyloom.operators import routing as R
from tallyloom.operators.joins import keyed_join
from tallyloom.sources import results
from tallyloom.sources.delimited import readable_directly, stream_contents
from tallyloom.sources.formats import Formats
from tallyloom.sources.scan import MOST_TABLE_BYTES

TABLE = "delimited"
#: Peak columns that every reader fills, in this order.
PEAKS = {
    "channel": "string", "detector": "string", "peak_number": "decimal(38,0)", "retention_time": "double", "retention_time_unit": "string", "area": "double", "height": "double",
    "compound": "string", "compound_source": "string", "observation_order": "int", "start_time": "double", "end_time": "double", "area_unit": "string", "height_unit": "string",
    "secondary_retention_time": "double", "secondary_retention_time_unit": "string",
}


def rules(formats: Formats | None = None) -> list[R.Rule]:
    """The claims of the readers: each result text by the marks of its first bytes, user formats by
    their own columns over ``content`` and ``extension``, and any other file as a delimited table."""
    has = lambda mark: R.has_marker(F.col("content"), mark)
    own = [
        R.Rule("sectioned_text", has(b"[Header]") & has(b"[Peak Table"), F.lit(0.95)),
        R.Rule("signal_sections", has(b"Signal No."), F.lit(0.95)),
        R.Rule("two_dimensional_text", has(b"1st Dimension Time (s)") & has(b"2nd Dimension Time (s)"), F.lit(0.95)),
        R.Rule("result_xml", has("<Chromatograms".encode("utf-16-le")), F.lit(0.95)),
        R.Rule(TABLE, F.lit(True), F.lit(0.3)),
    ]
    return own + (list(formats.rules.values()) if formats else [])


def probed(spark: SparkSession, sources: DataFrame, paths: list[str], recursive: bool, formats: Formats | None = None) -> DataFrame:
    """``file_id, adapter, matched, confidence, private, reason`` of each source and reader.

    Readers look at contents in the scan; what is joined with the sources is a path and its claims.
    """
    held = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(paths).where(F.col("length") <= MOST_TABLE_BYTES)
    claims = held.select("path", "content", T.extension(F.col("path")).alias("extension")).select("path", R.graded_probes(rules(formats)).alias("probes"))
    return cut(claims.dropDuplicates(["path"]).join(sources.select("file_id", "path"), "path").select("file_id", F.inline("probes")))


def routed(spark: SparkSession, sources: DataFrame, paths: list[str], recursive: bool, formats: Formats | None = None, forced: str | None = None) -> DataFrame:
    """``file_id, content, adapter, code`` of each source: content only where a reader needs it whole.

    Contents are read a second time for those files alone, where executors can open them by themselves; else they
    are joined as Spark scans them.
    """
    routes = cut(R.best_routes(sources, probed(spark, sources, paths, recursive, formats), forced))
    whole = cut(sources.select("file_id", "path").join(routes.where((F.col("adapter") != TABLE) & F.col("code").isNull()).select("file_id"), "file_id", "left_semi"))
    if readable_directly(paths):
        content = stream_contents(whole)
    else:
        held = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(paths).where(F.col("length") <= MOST_TABLE_BYTES)
        content = keyed_join(held.select("path", "content"), whole, ["path"]).dropDuplicates(["file_id"]).select("file_id", "content")
    return cut(routes.join(content, "file_id", "left").select("file_id", "content", "adapter", "code"))


def _filled(peaks: DataFrame) -> DataFrame:
    has = set(peaks.columns)
    value = lambda c, t: F.col(c).cast(t) if c in has else F.lit(None).cast(t)
    return peaks.select("file_id", *[value(c, t).alias(c) for c, t in PEAKS.items()], value("line_no", "int").alias("line_no"))


def result_peaks(files: DataFrame, formats: Formats | None = None) -> tuple[DataFrame, DataFrame]:
    """Peaks (``file_id, row_no`` and ``PEAKS``) and issues of the files that aren't plain tables."""
    of = lambda name: files.where(F.col("adapter") == name)
    sectioned, _, _ = results.sectioned_result(results.text_lines(of("sectioned_text")))
    sectioned = sectioned.withColumn("channel", F.regexp_extract("section", r"\(([^)]*)\)$", 1)).withColumn("retention_time_unit", F.lit("min"))
    korean = of("signal_sections").select("file_id", F.encode(results.korean_text(F.col("content")), "UTF-8").alias("content"))
    undecoded = korean.where("content is null").select("file_id", F.lit("INVALID_CP949").alias("code"))
    signals, _ = results.signal_sections(results.text_lines(korean.where("content is not null")))
    signals = signals.withColumnRenamed("signal_name", "channel").withColumn("retention_time_unit", F.lit("min"))
    plane, misshapen = results.two_dimensional_result(results.text_lines(of("two_dimensional_text")))
    document, differing = results.xml_result(of("result_xml"))
    parts, faults = [_filled(p) for p in (sectioned, signals, plane, document)], [undecoded, misshapen.select("file_id", "code"), differing.select("file_id", "code")]
    for name in formats.parsers if formats else ():
        rows, issues = formats.parse(name, of(name))
        parts.append(_filled(rows))
        faults.append(issues.select("file_id", "code"))
    place = Window.partitionBy("file_id").orderBy("channel", "observation_order", "peak_number", "retention_time", "area", "line_no")
    peaks = reduce(DataFrame.unionByName, parts).withColumn("row_no", F.row_number().over(place)).drop("line_no")
    issues = reduce(DataFrame.unionByName, faults).distinct().withColumn("severity", F.lit("error"))
    empty = files.where((F.col("adapter") != TABLE) & F.col("code").isNull()).join(cut(peaks).select("file_id").distinct(), "file_id", "left_anti")
    none = empty.join(issues.select("file_id").distinct(), "file_id", "left_anti").select("file_id", F.lit("NO_PEAKS_REPORTED").alias("code"), F.lit("warning").alias("severity"))
    return peaks, issues.unionByName(none)


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")
