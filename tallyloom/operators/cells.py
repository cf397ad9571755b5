"""From cells to peaks: headers, aliases, typed fields, kept raw values.

``cells`` has one row for each cell: ``file_id, row_no, col_no, header, lexeme`` and, for typed
sheets, ``sheet_no, cell_type, formula``. Row 0 is the header row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.functions import lexemes as L
from tallyloom.functions import text as T

#: Accepted spellings of each field (fixed values).
ALIASES = {
    "sample_id": "sample_id", "acquired_at": "acquired_at", "sequence": "sequence", "instrument_type": "instrument_type", "instrument": "instrument_type",
    "vendor": "vendor", "channel": "channel", "detector": "detector", "runtime": "runtime", "peak_number": "peak_number", "retention_time": "retention_time",
    "rt": "retention_time", "retention_time_unit": "retention_time_unit", "area": "area", "height": "height", "compound": "compound",
    "compound_source": "compound_source", "time": "time", "x": "time", "signal": "signal", "response": "signal", "y": "signal", "x_unit": "x_unit", "y_unit": "y_unit",
}
FIELDS = tuple(dict.fromkeys(ALIASES.values()))
PEAK_EVIDENCE = ("retention_time_unit", "compound", "compound_source", "peak_number", "retention_time", "area", "height")
NUMBERS = ("retention_time", "area", "height", "time", "signal", "runtime")
INTEGERS = ("peak_number", "sequence")
TEXTS = ("sample_id", "instrument_type", "vendor", "channel", "detector", "retention_time_unit", "compound", "compound_source", "x_unit", "y_unit")
FILE_FIELDS = ("acquired_at", "sequence", "runtime", "instrument_type", "vendor")


def alias_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ALIASES.items()), "normalized string, semantic string")


def semantic_headers(headers: DataFrame) -> DataFrame:
    """``headers (file_id, col_no, header)`` with ``semantic`` and, where two columns are the same,
    ``code``: ``DUPLICATE_HEADER`` or ``DUPLICATE_SEMANTIC_HEADER``."""
    named = headers.withColumn("normalized", T.normal_header(F.col("header")))
    named = named.join(F.broadcast(alias_table(headers.sparkSession)), "normalized", "left")
    same = F.count("*").over(Window.partitionBy("file_id", "normalized"))
    meant = F.count("semantic").over(Window.partitionBy("file_id", "semantic"))
    code = F.when(same > 1, "DUPLICATE_HEADER").when(F.col("semantic").isNotNull() & (meant > 1), "DUPLICATE_SEMANTIC_HEADER")
    return named.withColumn("code", code)


def compatible_files(headers: DataFrame) -> DataFrame:
    """``file_id, compatible``: at least one known column and no column twice."""
    s = semantic_headers(headers)
    return s.groupBy("file_id").agg((F.bool_or(F.col("semantic").isNotNull()) & ~F.bool_or(F.col("code").isNotNull())).alias("compatible"))


def header_widths(headers: DataFrame) -> DataFrame:
    """``file_id, width``: columns up to the last header that isn't blank; files without one have 0."""
    return headers.groupBy("file_id").agg(F.coalesce(F.max(F.when(L.stripped(F.col("header")) != "", F.col("col_no"))), F.lit(0)).alias("width"))


def data_cells(cells: DataFrame) -> DataFrame:
    """Cells of the data rows that aren't wholly empty; white space counts as data."""
    filled = cells.where("row_no > 0").groupBy("file_id", "row_no").agg(F.count_if(F.col("lexeme") != "").alias("n")).where("n > 0")
    return cells.join(filled.select("file_id", "row_no"), ["file_id", "row_no"], "left_semi")


def field_columns(headers: DataFrame) -> DataFrame:
    """``file_id, known, <field>...``: the column of each known field that a file has in one column only, and all of those."""
    meaning = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    named = headers.select("file_id", "col_no", meaning[T.normal_header(F.col("header"))].alias("semantic")).where("semantic is not null")
    at = {f: F.when(F.col("semantic") == f, F.col("col_no")) for f in FIELDS}
    columns = named.groupBy("file_id").agg(*[F.when(F.count(c) == 1, F.min(c)).alias(f"at_{f}") for f, c in at.items()])
    known = F.array_compact(F.array(*[F.col(f"at_{f}") for f in FIELDS]))
    return columns.withColumn("known", known).where(F.size("known") > 0)


def wide_rows(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """One row for each data row, with a raw lexeme column for each known field.

    Cells are gathered to rows once; a row without any text, or without a cell in a known column, is none.
    """
    rows = cells.where("row_no > 0").groupBy("file_id", "row_no").agg(F.collect_list(F.struct("col_no", "lexeme")).alias("c"), F.max(F.col("lexeme") != "").alias("filled")).where("filled")
    held = rows.join(field_columns(headers), "file_id").where(F.arrays_overlap("c.col_no", "known"))
    cell = lambda at: F.when(F.col(at).isNotNull(), F.get(F.filter("c", lambda x: x["col_no"] == F.col(at)), F.lit(0))["lexeme"])
    return held.select("file_id", "row_no", *[cell(f"at_{f}").alias(f) for f in FIELDS])


def typed_rows(rows: DataFrame) -> DataFrame:
    """Each field typed as ``value, code``; the raw lexemes stay beside them as ``raw_<field>``."""

    def typed(field: str) -> Column:
        raw = F.col(field)
        if field in NUMBERS:
            return L.exact_float(raw)
        if field in INTEGERS:
            return L.bounded_integer(raw)
        return L.iso_timestamp(raw) if field == "acquired_at" else L.mapped_text(raw)

    held = rows.select("file_id", "row_no", *[typed(f).alias(f) for f in FIELDS], *[F.col(f).alias(f"raw_{f}") for f in FIELDS])
    return held


def value_issues(typed: DataFrame) -> DataFrame:
    """``file_id, row_no, field, code, severity`` of values that were not taken as they stand."""
    taken = {f: F.col(f)["code"] for f in FIELDS}
    trimmed = {f: L.parse_lexeme(F.col(f"raw_{f}"))["code"] for f in (*NUMBERS, *INTEGERS, "acquired_at")}
    told = typed.where(F.coalesce(*taken.values(), *trimmed.values()).isNotNull())  # most rows have no issue
    found = F.array(*[F.when(c.isNotNull(), F.struct(F.lit(f).alias("field"), c.alias("code"))) for codes in (taken, trimmed) for f, c in codes.items()])
    return told.select("file_id", "row_no", F.inline(F.array_compact(found))).withColumn("severity", F.lit("warning"))


def raw_metadata(typed: DataFrame) -> DataFrame:
    """Raw lexemes that gave no exact value, once for each row and field, as metadata."""
    kept = [f for f in FIELDS]
    cells = F.array(*[F.struct(F.lit(f).alias("key"), F.col(f"raw_{f}").alias("value"), F.col(f)["code"].alias("code")) for f in kept])
    rows = typed.select("file_id", "row_no", F.inline(cells)).where("code is not null and value <> ''")
    return rows.select("file_id", F.lit("raw").alias("namespace"), "key", "value", F.concat(F.lit("table:row:"), "row_no").alias("source"))


def value_columns(typed: DataFrame) -> DataFrame:
    """The typed rows with plain columns in place of the structs."""
    plain = [F.col(f)["value"].alias(f) for f in FIELDS]
    return typed.select("file_id", "row_no", *plain, F.col("acquired_at")["reliable"].alias("acquired_at_reliable"))


def peak_rows(values: DataFrame) -> DataFrame:
    """Rows that tell of a peak."""
    return values.where(F.coalesce(*[F.col(c).cast("string") for c in PEAK_EVIDENCE]).isNotNull())


def signal_rows(values: DataFrame) -> DataFrame:
    """Rows with both a time and a signal."""
    return values.where("time is not null and signal is not null")


def unknown_columns(rows: DataFrame, file_id: str, columns: list[str]) -> DataFrame:
    """Columns without a known meaning as ``file_id, key, value`` metadata, headers kept verbatim."""
    cells = F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in columns])
    return rows.select(F.col(file_id).alias("file_id"), F.inline(cells))


def unmapped_cells(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """Cells of unknown columns, and beyond the header (as ``unmapped_column_N``), as metadata."""
    known = semantic_headers(headers).select("file_id", "col_no", "semantic", F.col("header").alias("label"))
    widths = header_widths(headers)
    # A cell with text makes its row a data row.
    held = cells.where("row_no > 0 and lexeme <> ''").join(widths, "file_id").join(known, ["file_id", "col_no"], "left").where("semantic is null")
    beyond = F.col("col_no") > F.col("width")
    key = F.when(beyond, F.format_string("unmapped_column_%d", "col_no")).otherwise(F.col("label"))
    return held.select("file_id", key.alias("key"), F.col("lexeme").alias("value"), F.concat(F.lit("table:row:"), "row_no", F.lit(":column:"), "col_no").alias("source"), beyond.alias("beyond"))


def extra_cell_issues(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """One issue for each row with data beyond the header."""
    extra = unmapped_cells(cells, headers).where("beyond").select("file_id", F.regexp_extract("source", r":row:(\d+)", 1).cast("int").alias("row_no")).distinct()
    return extra.select("file_id", "row_no", F.lit("UNMAPPED_EXTRA_CELLS").alias("code"), F.lit("warning").alias("severity"))


def formula_cells(cells: DataFrame) -> DataFrame:
    """An issue for each cell with a formula; its cached value is never taken."""
    return cells.where("formula is not null").select("file_id", "row_no", "col_no", F.lit("FORMULA_NOT_EVALUATED").alias("code"), F.lit("warning").alias("severity"))


def typed_cell_policy(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """Sheet cells with ``taken`` (the lexeme, or null) and ``code`` by what their field accepts.

    Text fields take text cells, numeric fields text and number cells, times text and dates (ISO
    date cells need a time part); formula cells are never values.
    """
    known = semantic_headers(headers).select("file_id", "col_no", "semantic")
    held = cells.join(known, ["file_id", "col_no"], "left")
    text, number, date = F.col("cell_type").isin("s", "str", "inlineStr"), F.col("cell_type") == "n", (F.col("cell_type") == "d") & F.col("lexeme").contains("T")
    fits = (
        F.when(F.col("semantic").isin(*TEXTS), text).when(F.col("semantic").isin(*NUMBERS, *INTEGERS), text | (number & ~F.coalesce("is_date", F.lit(False))))
        .when(F.col("semantic") == "acquired_at", text | date | (number & F.coalesce("is_date", F.lit(False)))).otherwise(F.lit(True))
    )
    empty = F.coalesce("lexeme", F.lit("")) == ""
    code = F.when(F.col("formula").isNotNull(), "FORMULA_NOT_EVALUATED").when(~fits & ~empty, "CELL_TYPE_MISMATCH")
    return held.withColumn("code", code).withColumn("taken", F.when(code.isNull() & ~empty, F.col("lexeme")))


def cell_provenance(cells: DataFrame) -> DataFrame:
    """Formula text, cached value, style and date mark of sheet cells as metadata rows."""
    letters = F.when(F.col("col_no") > 26, F.expr("concat(char(64 + (col_no - 1) div 26), char(65 + (col_no - 1) % 26))")).otherwise(F.expr("char(64 + col_no)"))
    where = F.concat(F.lit("sheet:"), "sheet_no", F.lit(":cell:"), letters, (F.col("row_no") + 1).cast("string"))
    pairs = F.array(
        F.struct(F.lit("formula").alias("key"), F.col("formula").alias("value")), F.struct(F.lit("formula_cached").alias("key"), F.col("formula_cached").alias("value")),
        F.struct(F.lit("style_index").alias("key"), F.col("style_index").cast("string").alias("value")), F.struct(F.lit("is_date").alias("key"), F.when(F.col("is_date"), "true").alias("value")),
    )
    return cells.select("file_id", where.alias("source"), F.inline(pairs)).where("value is not null")


def chosen_sheet(cells: DataFrame, title: str | None = None) -> DataFrame:
    """``file_id, sheet_no, code``: the named sheet, or the only visible one with a known schema."""
    headers = cells.where("row_no = 0").select("file_id", "sheet_no", "sheet_title", "sheet_state", "col_no", F.col("lexeme").alias("header"))
    key = F.struct("file_id", "sheet_no")
    fit = compatible_files(headers.withColumn("file_id", key)).select(F.col("file_id.file_id").alias("file_id"), F.col("file_id.sheet_no").alias("sheet_no"), "compatible")
    about = headers.select("file_id", "sheet_no", "sheet_title", "sheet_state").distinct()
    able = about.join(fit, ["file_id", "sheet_no"])
    ok = (F.col("sheet_title") == title) if title else (F.col("sheet_state") == "visible") & F.col("compatible")
    n = able.groupBy("file_id").agg(F.count_if(ok).alias("n"), F.min(F.when(ok, F.col("sheet_no"))).alias("sheet_no"))
    code = F.when(F.col("n") == 0, "SHEET_NOT_FOUND").when(F.col("n") > 1, "SHEET_AMBIGUOUS")
    return n.select("file_id", F.when(code.isNull(), F.col("sheet_no")).alias("sheet_no"), code.alias("code"))


def column_counts(rows: DataFrame) -> DataFrame:
    """Per file: rows that aren't empty, rows with each main field, and distinct signals."""
    filled = lambda c: F.count_if(L.stripped(F.col(c)) != "")
    return rows.groupBy("file_id").agg(
        F.count("*").alias("n_rows"), filled("retention_time").alias("n_rt"), filled("area").alias("n_area"), filled("height").alias("n_height"),
        F.count_distinct(F.struct("detector", "channel")).alias("n_signals"),
    )
