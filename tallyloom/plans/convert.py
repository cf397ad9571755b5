"""From folders of results to ordered tables.

Some intermediate tables are written to the shared folder while the plan is built, so calling
``convert`` or ``inspect`` runs jobs; the tables that they return are evaluated when they are used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.functions.shared import cut
from tallyloom.operators import cells as C
from tallyloom.operators import order as O
from tallyloom.operators import routing as R
from tallyloom.operators import summary as M
from tallyloom.operators import tables as P
from tallyloom.operators import validate as V
from tallyloom.plans import mapped
from tallyloom.plans import routes as routing
from tallyloom.plans.planning import MAX_PLAN_BYTES, MAX_PLAN_FILES, plan_changes, plan_entries, plan_limit
from tallyloom.plans.publish import publish  # noqa: F401
from tallyloom.plans.recipes import Recipe
from tallyloom.sources import scan
from tallyloom.sources.formats import Formats


@dataclass(frozen=True)
class Converted:
    """The tables of a conversion."""

    files: DataFrame
    samples: DataFrame
    peaks: DataFrame
    signals: DataFrame | None
    metadata: DataFrame
    issues: DataFrame
    decision: DataFrame
    import_log: DataFrame
    matrix: DataFrame
    summary: DataFrame
    #: Ten counters of sources and records, and counters by mapping route (one row each).
    results: DataFrame
    route_counts: DataFrame
    #: ``file_id, mapping_route, mapping_profile_id`` of all files, and profiles that nearly fit unread tables.
    routes: DataFrame
    drift: DataFrame | None
    recipe: Recipe
    sources: DataFrame


def inspect(spark: SparkSession, paths: list[str], recipe: Recipe | None = None, formats: Formats | None = None) -> tuple[DataFrame, DataFrame]:
    """What a conversion would say, with nothing published: each file's reader and status, and all issues."""
    out = convert(spark, paths, recipe, formats)
    return out.files.select("file_id", "relative_path", "adapter", "status", "error_code", "warning_code"), out.issues


def plan(spark: SparkSession, paths: list[str], recipe: Recipe | None = None, formats: Formats | None = None, limits: tuple[int, int] = (MAX_PLAN_FILES, MAX_PLAN_BYTES), output: str = "results") -> DataFrame:
    """The entries of a dry run (see ``planning.plan_entries``): files are listed, hashed and routed, and of tables the
    header lines are read; nothing is parsed or published. More files or bytes than ``limits`` are refused before any
    is read. Files that an earlier run wrote under the name ``output`` are left out."""
    recipe = recipe or Recipe()
    listed = scan.discover(spark, paths, recipe.recursive, list(recipe.extensions) or None)
    if code := plan_limit(listed, *limits):
        raise PlanRefused(code)
    sources = scan.own_outputs(_identified(listed, paths, recipe), output)
    fresh = sources.where("duplicate_of is null and not excluded")
    found = routing.probed(spark, fresh, paths, recipe.recursive, formats)
    routes = cut(R.best_routes(fresh, found, recipe.adapter).select("file_id", "adapter", "code"))
    tables = fresh.join(routes.where(F.col("adapter") == routing.TABLE).select("file_id"), "file_id", "left_semi")
    heads = cut(scan.read_heads(spark, tables, paths, recipe.recursive))
    broken = heads.where("error is not null").select("file_id", F.col("error").alias("fault"))
    headers = _headers(heads.where("error is null"))
    if recipe.profiles:
        own = cut(mapped.mapping_routes(headers, tables, recipe, spark)[0])
        refused = own.where("mapping_profile_id is null").select("file_id", mapped.refusal(F.col("mapping_route")).alias("fault"))
        routes = routes.join(own, "file_id", "left")
    else:
        fit = C.compatible_files(headers)
        refused = tables.select("file_id").join(fit.where("compatible").select("file_id"), "file_id", "left_anti").select("file_id", F.lit("FORMAT_NOT_DETECTED").alias("fault"))
    faults = broken.unionByName(refused.join(broken.select("file_id"), "file_id", "left_anti"))
    routes = routes.join(faults, "file_id", "left").withColumn("code", F.coalesce("code", "fault")).drop("fault")
    return cut(plan_entries(sources, routes))


class PlanRefused(ValueError):
    """A plan beyond its limits, or one that no longer tells of its files."""


def _identified(listed: DataFrame, paths: list[str], recipe: Recipe) -> DataFrame:
    """The listed files with hashes, distinct relative paths and marks of duplicates."""
    return cut(scan.mark_duplicates(scan.distinct_paths(scan.with_hash(listed, paths, recipe.recursive)), "path"))


def _headers(cells: DataFrame) -> DataFrame:
    return cells.where("row_no = 0").select("file_id", "col_no", F.col("lexeme").alias("header")).where("trim(header) <> ''")


def convert(spark: SparkSession, paths: list[str], recipe: Recipe | None = None, formats: Formats | None = None, reviewed: DataFrame | None = None, limits: tuple[int, int] | None = None) -> Converted:
    """Read result files, type them strictly, keep bad files apart and order the rest.

    With ``reviewed``, the entries of a plan, the plan is made again first: files that came, went or changed since are an
    error, and so are, with ``limits``, more files or bytes than those. With profiles in the recipe, delimited tables are read by the one profile that has
    their very headers, and by nothing else.

    Sectioned and two-dimensional texts, signal sections, result XML and the user's ``formats`` go to
    their readers, by probes of their content or all to the recipe's ``adapter``; other files are
    delimited tables. Every file has a row in ``files`` and ``import_log``; rows of files with an error are in no
    other table.
    """
    recipe = recipe or Recipe()
    if reviewed is not None:
        changed = plan_changes(reviewed, plan(spark, paths, recipe, formats, limits or (MAX_PLAN_FILES, MAX_PLAN_BYTES)))
        if told := [r["change"] for r in changed.groupBy("change").count().collect()]:
            raise PlanRefused(f"CONVERSION_PLAN_STALE: {', '.join(sorted(told))}")
    listed = scan.discover(spark, paths, recipe.recursive, list(recipe.extensions) or None)
    if limits is not None and (code := plan_limit(listed, *limits)):
        raise PlanRefused(code)
    sources = _identified(listed, paths, recipe)
    fresh = sources.where("duplicate_of is null")
    routes = routing.routed(spark, fresh, paths, recipe.recursive, formats, recipe.adapter)
    unclear = routes.where("code is not null").select("file_id", "code", F.lit("error").alias("severity"))
    other, other_issues = routing.result_peaks(routes.where("code is null"), formats)
    tables = fresh.join(routes.where(F.col("adapter") == routing.TABLE).select("file_id"), "file_id", "left_semi")
    cells = cut(scan.read_cells(spark, tables, paths, recipe.recursive))
    broken = cells.where("error is not null").select("file_id", F.col("error").alias("code"), F.lit("error").alias("severity"))
    good = cells.where("error is null")
    headers = _headers(good)
    own = mapped.mapped_tables(good, headers, tables.select("file_id", "path", "extension"), recipe) if recipe.profiles else None
    if own:  # the profiles alone read delimited tables
        good, headers = good.limit(0), headers.limit(0)
    named = C.semantic_headers(headers)
    bad_headers = named.where("code is not null").select("file_id", "code", F.lit("error").alias("severity")).distinct()
    fit = C.compatible_files(headers)
    unknown = fit.join(bad_headers.select("file_id").distinct(), "file_id", "left_anti").where("not compatible").select("file_id", F.lit("FORMAT_NOT_DETECTED").alias("code"), F.lit("error").alias("severity"))
    able = good.join(fit.where("compatible").select("file_id"), "file_id", "left_semi")
    typed = cut(C.typed_rows(C.wide_rows(able, headers)))
    values = C.value_columns(typed)

    place = ["row_no"]
    stem = values.join(sources.select("file_id", routing.stem(F.col("name")).alias("stem")), "file_id")
    bound = O.elect_sample_id(stem, F.col("stem"), place)
    fields = [F.first(f, ignorenulls=True).over(Window.partitionBy("file_id").orderBy("row_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias(f"__{f}") for f in (*C.FILE_FIELDS, "acquired_at_reliable")]
    samples = (
        bound.select("file_id", "sample_id", "row_no", "detector", "channel", *fields)
        .groupBy("file_id").agg(
            F.first("sample_id").alias("sample_id"), *[F.first(f"__{f}").alias(f) for f in (*C.FILE_FIELDS, "acquired_at_reliable")],
            O.ordered_distinct("detector", place).alias("detectors"), O.ordered_distinct("channel", place).alias("channels"),
        )
    )
    of_file = sources.select("file_id", F.col("relative_path").alias("source_file"), routing.stem(F.col("name")).alias("sample_id"))
    other = cut(other).join(of_file, "file_id").withColumn("status", F.lit("success"))
    facts_of = routes.where((F.col("adapter") != routing.TABLE) & F.col("code").isNull()).join(of_file, "file_id")
    streams = other.groupBy("file_id").agg(O.ordered_distinct("detector", place).alias("detectors"), O.ordered_distinct("channel", place).alias("channels"))
    blank = [F.lit(None).cast(samples.schema[f].dataType).alias(f) for f in (*C.FILE_FIELDS, "acquired_at_reliable")]
    samples = samples.unionByName(facts_of.join(streams, "file_id", "left").select("file_id", "sample_id", *blank, "detectors", "channels"))
    peaks = C.peak_rows(bound).join(of_file.drop("sample_id"), "file_id")
    none = lambda t: F.lit(None).cast(t)
    peaks = peaks.select(
        "file_id", "row_no", "sample_id", "source_file", "channel", "detector", "peak_number", "retention_time", "retention_time_unit", "area", "height", "compound", "compound_source",
        F.lit("success").alias("status"), none("int").alias("observation_order"), none("double").alias("start_time"), none("double").alias("end_time"), none("string").alias("area_unit"),
        none("string").alias("height_unit"), none("double").alias("secondary_retention_time"), none("string").alias("secondary_retention_time_unit"),
    )
    peaks = peaks.unionByName(other.select(peaks.columns))
    if own:
        mine, mine_samples = _mapped_peaks(own[0], of_file, samples, peaks.columns)
        peaks, samples = peaks.unionByName(mine), samples.unionByName(mine_samples)
    soft = C.value_issues(typed).select("file_id", "code", "severity").unionByName(C.extra_cell_issues(able, headers).select("file_id", "code", "severity"))
    more = bound.where("other_ids").select("file_id", F.lit("MULTIPLE_SAMPLE_IDS").alias("code"), F.lit("warning").alias("severity")).distinct()
    checks = V.peak_rules(peaks).select("file_id", "code").withColumn("severity", F.lit("error"))
    issues = broken.unionByName(unclear).unionByName(other_issues).unionByName(bad_headers).unionByName(unknown).unionByName(soft).unionByName(more).unionByName(checks).unionByName(scan.size_issues(sources).select("file_id", "code", "severity"))
    if own:
        issues = issues.unionByName(own[1].select("file_id", "code", "severity"))
    number = F.row_number().over(Window.partitionBy("file_id").orderBy("severity", "code"))
    issues = cut(issues.withColumn("issue_no", number).withColumn("message", F.col("code")))

    settled = F.when(F.col("duplicate_of").isNotNull(), "duplicate")
    log = P.import_log(sources.join(routes.select("file_id", "adapter"), "file_id", "left").withColumn("status", settled), issues)
    facts = samples.select("file_id", "acquired_at", F.col("acquired_at_reliable").alias("reliable"), "sequence")
    files = log.join(facts, "file_id", "left").withColumn("ok", F.col("status").isin(*P.OK)).withColumn("public_id", F.lit(None).cast("string")).withColumn("reliable", F.coalesce("reliable", F.lit(False)))
    if recipe.on_error == "stop":
        files = O.stop_after_failure(files.withColumn("settled", F.col("status") == "duplicate")).withColumn("ok", F.col("status").isin(*P.OK))
    ranked, decision = O.sort_files(cut(files), recipe.sort)
    kept = P.successful(peaks, ranked).join(ranked.select("file_id", "file_rank"), "file_id")
    matrix = P.compound_matrix_long(kept, ["file_rank", "row_no"])
    signals = P.successful(C.signal_rows(bound), ranked).select("file_id", "row_no", "sample_id", "detector", "channel", F.col("time").alias("x"), F.col("signal").alias("y"), "x_unit", "y_unit") if recipe.include_signals else None
    metadata = C.raw_metadata(typed).drop("namespace").unionByName(C.unmapped_cells(able, headers).drop("beyond"))
    if own:
        metadata = metadata.unionByName(own[4].select("file_id", "key", "value", F.lit("mapping").alias("source")))
    metadata = P.successful(metadata, ranked)
    counts = P.batch_counts(ranked)
    exact = (F.col("adapter") != routing.TABLE) & F.col("code").isNull()
    taken = routes.select("file_id", F.when(exact, "EXACT_ADAPTER").alias("mapping_route"), F.lit(None).cast("string").alias("mapping_profile_id"))
    if own:
        taken = taken.join(own[2].select("file_id"), "file_id", "left_anti").unionByName(own[2].select(taken.columns))
    series = C.signal_rows(bound).select("file_id", "detector", "channel").distinct().withColumn("series_kind", F.lit("SCIENTIFIC_SIGNAL"))
    told = M.result_summary(ranked, samples, peaks, series)
    log = ranked.select("file_id", "file_rank", "relative_path", "status", "warning_code", "error_code", "message", "sort_key", "sha256")
    return Converted(ranked, P.successful(samples, ranked), kept, signals, metadata, issues, decision, log, matrix, counts, told, M.route_counts(taken), taken, own[3] if own else None, recipe, sources)


def _mapped_peaks(rows: DataFrame, of_file: DataFrame, samples: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Peaks of mapped tables in the columns of all peaks, and their files' samples."""
    held = rows.join(of_file.withColumnRenamed("sample_id", "stem"), "file_id")
    bound = cut(O.elect_sample_id(held, F.col("stem"), ["row_no"]))
    has = set(bound.columns)
    kinds = {**routing.PEAKS, "row_no": "int", "file_id": "long", "sample_id": "string", "source_file": "string", "status": "string"}
    value = lambda c: F.lit("success") if c == "status" else F.col(c).cast(kinds[c]) if c in has else F.lit(None).cast(kinds[c])
    per_file = bound.groupBy("file_id").agg(F.first("sample_id").alias("sample_id"), O.ordered_distinct("detector", ["row_no"]).alias("detectors"), O.ordered_distinct("channel", ["row_no"]).alias("channels"))
    blank = [F.lit(None).cast(samples.schema[f].dataType).alias(f) for f in samples.columns if f not in per_file.columns]
    return bound.select(*[value(c).alias(c) for c in columns]), per_file.select("*", *blank).select(samples.columns)
