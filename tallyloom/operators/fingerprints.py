"""Fingerprints of mapping profiles by kind, as columns over profile tables.

Four kinds, each for one purpose: the exact structure (local; labels count), the public structure (no
labels, titles or names), the semantics (everything that changes a result, but no display label), and a set of profiles in its
order. All are SHA-256 of canonical JSON, so the order of fields and of rows never counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.canonical import digest

#: The versions that the fingerprints name (fixed values).
FINGERPRINT_VERSION = MAPPING_VERSION = SET_VERSION = 1
IGNORED = "IGNORED"


def _with(df: DataFrame, name: str, value, tag: str = "") -> DataFrame:
    held = df.withColumn("__v", value)
    return held.withColumn(name, digest(F.col("__v"), held.schema["__v"].dataType, tag)).drop("__v")


def profile_fingerprints(profiles: DataFrame, columns: DataFrame) -> DataFrame:
    """``profile_id, exact_structure, public_structure, semantic`` of each profile.

    ``profiles`` has ``profile_id, source_format, worksheet_title, retention_time_unit, area_unit, height_unit,
    secondary_retention_time_unit`` (and may have a display label, which no fingerprint reads); ``columns`` has
    ``profile_id, position, label, role``. Profiles without columns have empty lists.
    """
    row = F.struct("position", "label", "role")
    lists = columns.groupBy("profile_id").agg(F.sort_array(F.collect_list(row)).alias("c"))
    held = profiles.join(lists, "profile_id", "left").withColumn("c", F.coalesce("c", F.array().cast("array<struct<position:int,label:string,role:string>>")))
    held = held.withColumn("headers", F.transform("c", lambda x: x["label"])).withColumn("roles", F.transform("c", lambda x: x["role"]))
    known = lambda c: F.col(c).isNotNull().alias(c.removesuffix("_unit"))
    policy = F.when(F.col("source_format") != "xlsx", "NOT_APPLICABLE").when(F.col("worksheet_title").isNotNull(), "EXACT_TITLE").otherwise("SINGLE_VISIBLE")
    held = _with(held, "exact_structure", F.struct("headers", "source_format", "worksheet_title"))
    held = _with(
        held, "public_structure",
        F.struct(
            F.lit(FINGERPRINT_VERSION).alias("fingerprint_schema_version"), F.lit(MAPPING_VERSION).alias("mapping_schema_version"), "source_format", F.size("c").alias("column_count"),
            F.col("roles").alias("ordered_roles"), policy.alias("worksheet_policy"),
            F.struct(F.lit(True).alias("retention_time"), *[known(c) for c in ("area_unit", "height_unit", "secondary_retention_time_unit")]).alias("unit_presence"),
        ),
    )
    units = F.struct("retention_time_unit", "area_unit", "height_unit", "secondary_retention_time_unit").alias("units")
    semantic = F.struct("source_format", "worksheet_title", units, F.col("c").alias("columns"))
    return _with(held, "semantic", semantic).select("profile_id", "exact_structure", "public_structure", "semantic")


def set_fingerprint(members: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """``set_id, n_profiles, fingerprint`` of each set: its profiles' public structures in their order ``(set_id,
    position, profile_id)``."""
    held = members.join(fingerprints.select("profile_id", "public_structure"), "profile_id")
    lists = held.groupBy("set_id").agg(F.sort_array(F.collect_list(F.struct("position", "public_structure"))).alias("p"))
    lists = lists.withColumn("profiles", F.transform("p", lambda x: x["public_structure"]))
    value = F.struct(F.lit(FINGERPRINT_VERSION).alias("fingerprint_schema_version"), F.lit(SET_VERSION).alias("mapping_set_schema_version"), "profiles")
    return _with(lists, "fingerprint", value).select("set_id", F.size("p").alias("n_profiles"), "fingerprint")


def repeated_profiles(fingerprints: DataFrame) -> DataFrame:
    """Profiles that another one of the table equals in structure and semantics: such a set is refused."""
    same = fingerprints.groupBy("exact_structure", "semantic").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("profile_id")).alias("profile_ids"))
    return same.where("n > 1").select("profile_ids", "n")
