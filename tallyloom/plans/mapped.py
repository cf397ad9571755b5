"""Tables that profiles of a recipe may own: exact matches are read, all others tell why not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.shared import cut
from tallyloom.operators import mapping as M
from tallyloom.operators import routing as R
from tallyloom.operators import summary as S
from tallyloom.plans.recipes import Recipe

#: What a route that isn't one is told as (fixed values).
CODES = {"AMBIGUOUS_MAPPING_PROFILE": "PEAK_MAPPING_PROFILE_AMBIGUOUS", "SCHEMA_DRIFT_CANDIDATE": "PEAK_MAPPING_PROFILE_NOT_MATCHED", "NO_MAPPING_MATCH": "PEAK_MAPPING_PROFILE_NOT_MATCHED"}
#: Delimiters' names as source formats, by suffix (fixed values).
FORMATS = {".csv": "csv", ".tsv": "tsv", ".txt": "semicolon"}


def table_structures(headers: DataFrame, tables: DataFrame, requested: tuple[str, ...]) -> DataFrame:
    """``file_id, source_format, headers`` of delimited tables whose suffix suits a requested format."""
    lists = headers.groupBy("file_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("col_no", "header"))), lambda x: x["header"]).alias("headers"))
    kind = F.coalesce(*[F.when(F.col("extension") == suffix, F.lit(name)) for suffix, name in FORMATS.items()])
    held = tables.where(F.size(S.candidate_formats(F.col("path"), requested)) > 0).select("file_id", kind.alias("source_format"))
    return held.join(lists, "file_id").where(F.col("source_format").isin(*requested))


def refusal(route: Column) -> Column:
    """The error code of a table that no profile reads."""
    return F.create_map(*[F.lit(x) for pair in CODES.items() for x in pair])[route]


def mapping_routes(headers: DataFrame, tables: DataFrame, recipe: Recipe, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """``file_id, mapping_route, mapping_profile_id`` of delimited tables by their headers alone, and the profiles
    that nearly fit the others."""
    profiles, columns = recipe.profile_tables(spark)
    requested = tuple(sorted({p.source_format for p in recipe.profiles}))
    structures = cut(table_structures(headers, tables, requested))
    matches = cut(R.profile_matches(structures, profiles))
    # Only what no profile owns is looked at for drift; the few different header lists are compared once each.
    free = structures.join(matches.where("n_profiles = 0").select("file_id"), "file_id", "left_semi")
    drift = cut(M.drift_candidates(M.drift_diagnostics(free, profiles, columns.select("profile_id", "position", "role"))))
    near = drift.where(~F.array_contains("categories", "incompatible_structure"))
    nothing = tables.select("file_id", F.lit(None).cast("string").alias("adapter"))
    routes = R.classify_routes(nothing, matches, near, single_mapping=len(recipe.profiles) == 1)
    return routes.select("file_id", F.col("route").alias("mapping_route"), F.col("profile_id").alias("mapping_profile_id")), drift


def mapped_tables(cells: DataFrame, headers: DataFrame, tables: DataFrame, recipe: Recipe) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Peaks, issues, routes, candidates of drift and provenance of the tables that the recipe's profiles look at.

    ``cells`` and ``headers`` are of delimited files, ``tables`` has ``file_id, path, extension``. A table is read by the one
    profile with its very headers. Where a set of profiles is given, no other delimited table is read.
    """
    spark = cells.sparkSession
    profiles, columns = recipe.profile_tables(spark)
    routes, drift = mapping_routes(headers, tables, recipe, spark)
    routes = cut(routes)
    owned = routes.where("mapping_profile_id is not null")
    body = cells.where("row_no > 0").join(owned.select("file_id", F.col("mapping_profile_id").alias("profile_id")), "file_id")
    peaks, faults = M.mapped_peaks(body, columns, profiles.select("profile_id", "retention_time_unit", "area_unit"))
    peaks = cut(peaks)
    refused = routes.where("mapping_profile_id is null").select("file_id", refusal(F.col("mapping_route")).alias("code"))
    issues = refused.unionByName(faults.select("file_id", "code").distinct()).withColumn("severity", F.lit("error"))
    return peaks, issues, routes, drift, M.mapping_provenance(peaks, profiles, columns)
