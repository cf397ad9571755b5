"""Readers of vendor result texts, as rules over lines.

``lines`` has ``file_id, line_no, line``. Each reader is a set of column expressions over all
files at once; nothing here loops over files.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.functions import lexemes as L
from tallyloom.functions import text as T
from tallyloom.operators.order import carry_section


def text_lines(files: DataFrame, content: str = "content", charset: str = "UTF-8") -> DataFrame:
    """``file_id, line_no, line`` of decoded files."""
    text = F.decode(F.col(content), charset) if charset != "UTF-8" else F.col(content).cast("string")
    return files.select("file_id", F.posexplode(F.split(text, "\r?\n")).alias("line_no", "line"))


def korean_text(content: Column) -> Column:
    """Text of CP949 bytes, which the JVM function set doesn't offer; null where they aren't."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        def one(raw) -> str | None:
            try:
                return bytes(raw).decode("cp949")
            except UnicodeDecodeError:
                return None

        return values.map(one, na_action="ignore")

    return run(content)


def _field(line: Column, k: int, sep: str = "\t") -> Column:
    return F.get(F.split(line, sep, -1), F.lit(k))


def sectioned_result(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Peaks, chromatogram points and facts ``(section, key, value)`` of ``[Section]`` texts.

    A peak table starts with its declared number of peaks and a header line; facts include it.
    """
    header = F.when(F.col("line").rlike(r"^\[[^\]]+\]$"), F.regexp_extract("line", r"^\[([^\]]+)\]$", 1))
    held = carry_section(lines, header, ["file_id"], ["line_no"]).where(header.isNull() & (F.col("line") != ""))
    pos = F.row_number().over(Window.partitionBy("file_id", "section").orderBy("line_no"))
    held = held.withColumn("n", pos)
    peak = held.where(F.col("section").startswith("Peak Table") & _field(F.col("line"), 0).rlike("^[0-9]+$"))
    order = F.row_number().over(Window.partitionBy("file_id", "section").orderBy("line_no"))
    # Numbered before they are typed: rows that went through an Arrow function would be dealt out again for the window.
    peak = peak.select("file_id", "section", order.alias("observation_order"), F.split("line", "\t", -1).alias("c"))
    number = lambda k: L.exact_float(F.get("c", F.lit(k)))["value"]
    peaks = peak.select(
        "file_id", "section", F.get("c", F.lit(0)).cast("int").alias("peak_number"), number(1).alias("retention_time"), number(2).alias("start_time"), number(3).alias("end_time"),
        number(4).alias("area"), number(5).alias("height"), T.known_name(F.element_at("c", -1)).alias("compound"), "observation_order",
    )
    point = held.where(F.col("section").startswith("Chromatogram") & F.col("line").rlike(r"^[0-9.]+\t-?[0-9.]+$"))
    point_no = (F.row_number().over(Window.partitionBy("file_id", "section").orderBy("line_no")) - 1).alias("point_no")
    point = point.select("file_id", "section", point_no, F.split("line", "\t", -1).alias("c"))
    points = point.select("file_id", "section", "point_no", number(0).alias("x"), number(1).alias("y"))
    fact = held.where(~F.col("line").rlike(r"^[0-9]")).select("file_id", "section", "n", _field(F.col("line"), 0).alias("key"), _field(F.col("line"), 1).alias("value"))
    return peaks, points, fact


def signal_sections(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Peaks and stated totals of results that repeat a header for each signal.

    A section ends with a ``Total`` row; what follows its blank line until the next header is not
    part of it.
    """
    is_header = F.col("line").startswith("Signal No.")
    line = Window.partitionBy("file_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    held = lines.withColumn("section", F.sum(is_header.cast("int")).over(line)).where("section > 0").where(~is_header)
    inside = Window.partitionBy("file_id", "section").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    held = held.withColumn("closed", F.max((F.col("line") == "").cast("int")).over(inside)).where("closed = 0")
    names = ("signal_no", "signal_name", "peak_number", "retention_time", "area", "height", "area_percent", "height_percent", "w05")
    cells = held.select("file_id", "section", "line_no", *[_field(F.col("line"), k).alias(n) for k, n in enumerate(names)])
    total = F.lower(F.concat_ws("", "signal_no", "signal_name", "peak_number")).contains("total")
    order = F.row_number().over(Window.partitionBy("file_id", "section").orderBy("line_no"))
    peaks = cells.where(~total & F.col("peak_number").rlike("^[0-9]+$")).withColumn("observation_order", order)
    typed = {n: L.vendor_decimal(F.col(n))["value"].alias(n) for n in ("retention_time", "area", "height")}
    peaks = peaks.select("file_id", "section", "signal_name", F.col("peak_number").cast("int").alias("peak_number"), *typed.values(), "observation_order", F.col("area").alias("area_lexeme"), F.col("height").alias("height_lexeme"))
    return peaks, cells.where(total).select("file_id", "section", F.col("area").alias("area_total"), F.col("height").alias("height_total"))


TWO_DIMENSIONAL = ("name", "rt1", "rt2", "area", "height", "spectrum", "wb1", "wb2", "index")


def two_dimensional_result(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Peaks of nine-column tab-separated results, and the lines that aren't such rows."""
    rows = lines.where("line_no > 0 and line <> ''").withColumn("c", F.split("line", "\t", -1))
    fits = (F.size("c") == 9) & F.get("c", F.lit(1)).rlike(r"^[0-9]+(\.[0-9]+)?$") & F.get("c", F.lit(2)).rlike(r"^[0-9]+(\.[0-9]+)?$")
    order = F.row_number().over(Window.partitionBy("file_id").orderBy("line_no"))
    good = rows.where(fits).select("file_id", "line_no", *[F.get("c", F.lit(k)).alias(n) for k, n in enumerate(TWO_DIMENSIONAL)])
    peaks = good.select(
        "file_id", order.alias("observation_order"), T.known_name(F.col("name")).alias("compound"),
        *[L.vendor_decimal(F.col(a))["value"].alias(b) for a, b in (("rt1", "retention_time"), ("rt2", "secondary_retention_time"), ("area", "area"), ("height", "height"))],
        F.lit("s").alias("retention_time_unit"), F.lit("s").alias("secondary_retention_time_unit"), "spectrum", "wb1", "wb2", "index",
    )
    return peaks, rows.where(~fits).select("file_id", "line_no", F.lit("ROW_SHAPE_INVALID").alias("code"))


def spectrum_pairs(spectrum: Column, most: int = 10_000) -> Column:
    """``m:i m:i ...`` as an array of ``(m, i)``; null where the text isn't such a list."""
    fits = spectrum.rlike(r"^[0-9]+(\.[0-9]+)?:[0-9]+(\.[0-9]+)?( [0-9]+(\.[0-9]+)?:[0-9]+(\.[0-9]+)?)*$") & (F.size(F.split(spectrum, " ")) <= most)
    part = lambda p, k: F.get(F.split(p, ":"), F.lit(k)).try_cast("double")
    return F.when(fits, F.transform(F.split(spectrum, " "), lambda p: F.struct(part(p, 0).alias("m"), part(p, 1).alias("i"))))


def side_metadata(peaks: DataFrame, fields: list[str]) -> DataFrame:
    """``peak_NNNNNN_<field>`` metadata rows for each peak."""
    cells = F.array(*[F.struct(F.format_string(f"peak_%06d_{f}", "observation_order").alias("key"), F.col(f).cast("string").alias("value")) for f in fields])
    return peaks.select("file_id", F.inline(cells)).where("value is not null")


def constant_metadata(files: DataFrame, facts: list[tuple[str, str, str | None]]) -> DataFrame:
    """The same ``(key, value, unit)`` facts for each file."""
    rows = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("value"), F.lit(u).cast("string").alias("unit")) for k, v, u in facts])
    return files.select("file_id", F.inline(rows))


_XML = """struct<
  Chromatograms: struct<Signal: struct<Detector: string, SignalId: string, Description: string, Start: string, End: string, XUnits: string, YUnits: string,
    IntegrationResults: array<struct<RetTime: string, Area: string, Height: string, TimeStart: string, TimeEnd: string>>>>,
  Results: struct<ResultsGroup: struct<Peak: array<struct<MeasRetTime: struct<_VALUE: string, _Unit: string>, Area: struct<_VALUE: string, _Unit: string>, Height: struct<_VALUE: string, _Unit: string>, Name: string>>>>>"""


def xml_result(files: DataFrame, content: str = "content") -> tuple[DataFrame, DataFrame]:
    """Peaks of single-signal result documents, and the positions where the two lists differ.

    The results group and the integration rows describe the same peaks and are paired by position.
    """
    text = F.regexp_replace(F.decode(F.col(content), "UTF-16"), r"^﻿?<\?xml[^>]*\?>", "")
    doc = F.from_xml(text, _XML.replace("\n", " "), {"ignoreSurroundingSpaces": "false"})
    held = files.select("file_id", doc.alias("d"))
    held = held.select(
        "file_id", F.col("d.Chromatograms.Signal.SignalId").alias("channel"), F.col("d.Chromatograms.Signal.Detector").alias("detector"),
        F.col("d.Results.ResultsGroup.Peak").alias("p"), F.col("d.Chromatograms.Signal.IntegrationResults").alias("i"),
    )
    rows = held.select("file_id", "channel", "detector", F.posexplode(F.arrays_zip("p", "i")).alias("pos", "z"))
    same = F.col("z.p.MeasRetTime._VALUE").eqNullSafe(F.col("z.i.RetTime")) & F.col("z.p.Area._VALUE").eqNullSafe(F.col("z.i.Area")) & F.col("z.p.Height._VALUE").eqNullSafe(F.col("z.i.Height"))
    number = lambda c: L.exact_float(F.col(c))["value"]
    peaks = rows.where(same).select(
        "file_id", "channel", "detector", (F.col("pos") + 1).alias("observation_order"), number("z.p.MeasRetTime._VALUE").alias("retention_time"), F.col("z.p.MeasRetTime._Unit").alias("retention_time_unit"),
        number("z.p.Area._VALUE").alias("area"), F.col("z.p.Area._Unit").alias("area_unit"), number("z.p.Height._VALUE").alias("height"), F.col("z.p.Height._Unit").alias("height_unit"),
        number("z.i.TimeStart").alias("start_time"), number("z.i.TimeEnd").alias("end_time"), T.known_name(F.col("z.p.Name")).alias("compound"),
    )
    return peaks, rows.where(~same).select("file_id", "pos", F.lit("INTEGRATION_RESULT_MISMATCH").alias("code"))


def register_formats(spark: SparkSession) -> DataFrame:
    """The built-in formats as a table."""
    rows = [
        ("generic_csv", ".csv", "supported", False), ("generic_tsv", ".tsv", "supported", False), ("generic_txt", ".txt", "supported", False), ("result_xml", ".xml", "supported", True),
        ("sectioned_text", ".txt", "supported", True), ("signal_sections", ".csv", "supported", True), ("two_dimensional_text", ".txt", "supported", True),
    ]
    return spark.createDataFrame(rows, "adapter string, extension string, status string, private boolean")
