"""User-mapped tables: drift from a declared structure, candidates, fingerprints, repair."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.functions import lexemes as L
from tallyloom.functions.shared import cut

#: Drift categories in their fixed order.
CATEGORIES = (
    "column_added", "column_removed", "column_reordered", "header_changed_unresolved", "duplicate_header_changed",
    "required_mapping_column_missing", "optional_mapping_column_missing", "worksheet_identity_changed_unresolved", "incompatible_structure",
)
REQUIRED_ROLES = ("retention_time", "area")
#: What a column can stand for, besides ``IGNORED``.
ROLES = (
    "retention_time", "area", "height", "peak_name", "compound", "peak_number", "detector", "channel", "sample_id", "run_id", "acquired_at", "start_time", "end_time",
    "secondary_retention_time",
)
MAX_CANDIDATES = 3
#: Profiles of a set, and the last column of a table.
MAX_PROFILES, MAX_POSITION = 32, 16_384


def _tokens(headers: Column) -> Column:
    """``(label, k)`` of each column: k counts columns with the same label up to it."""
    return F.transform(headers, lambda h, i: F.struct(h.alias("label"), F.size(F.filter(F.slice(headers, 1, i + 1), lambda x: x == h)).alias("k")))


def drift_diagnostics(structures: DataFrame, profiles: DataFrame, roles: DataFrame | None = None) -> DataFrame:
    """How each file's headers differ from each profile of its format.

    Columns: expected and observed counts, exact position matches, changed, added, removed and moved
    columns, their total, the lost required and optional roles, and the categories in order.
    ``roles`` has ``profile_id, position, role``; ``IGNORED`` columns have no role. Where both tables have a
    ``worksheet_title``, a profile with one differs from workbooks whose read sheet has another (or none). Files share few
    header lists: each distinct one is compared once, in place on its short arrays, and joined back.
    """
    parts = ["source_format", "headers"]
    if "worksheet_title" in structures.columns and "worksheet_title" in profiles.columns:
        parts.append("worksheet_title")
    kinds = structures.select(*parts).distinct().withColumn("file_id", F.xxhash64(*parts))
    found = _diagnose(kinds, profiles, roles).withColumnRenamed("file_id", "kind")
    held = structures.withColumn("kind", F.xxhash64(*parts)).select("file_id", "kind")
    return held.join(found, "kind").drop("kind")


def _diagnose(structures: DataFrame, profiles: DataFrame, roles: DataFrame | None) -> DataFrame:
    """The diagnostics of each row of ``structures`` by itself."""
    sheets = "worksheet_title" in structures.columns
    p = profiles.select("profile_id", F.col("source_format").alias("f"), F.col("headers").alias("expected"), *([F.col("worksheet_title").alias("wanted_title")] if sheets else []))
    if roles is not None:
        held = roles.where("role <> 'IGNORED'").groupBy("profile_id").agg(F.sort_array(F.collect_list(F.struct("position", "role"))).alias("roles"))
        p = p.join(held, "profile_id", "left")
    else:
        p = p.withColumn("roles", F.lit(None).cast("array<struct<position:int,role:string>>"))
    j = structures.join(F.broadcast(p), F.col("source_format") == F.col("f")).withColumn("roles", F.coalesce("roles", F.array().cast("array<struct<position:int,role:string>>")))
    j = j.withColumn("e", _tokens(F.col("expected"))).withColumn("o", _tokens(F.col("headers")))
    at = lambda tokens, t: F.array_position(tokens, t)
    j = j.withColumn("added", F.array_except("o", "e")).withColumn("removed", F.array_except("e", "o"))
    j = j.withColumn("common_e", F.filter("e", lambda t: F.array_contains("o", t))).withColumn("common_o", F.filter("o", lambda t: F.array_contains("e", t)))
    exact = F.size(F.filter("common_e", lambda t: at(F.col("e"), t) == at(F.col("o"), t)))
    apart = F.filter(F.arrays_zip("common_e", "common_o"), lambda z: z["common_e"] != z["common_o"])
    moved = F.size(F.array_distinct(F.flatten(F.transform(apart, lambda z: F.array(z["common_e"], z["common_o"])))))
    j = j.withColumn("exact", exact).withColumn("moved", moved)
    both = F.least(F.size("expected"), F.size("headers"))
    spots = F.filter(F.sequence(F.lit(1), F.greatest(both, F.lit(1))), lambda i: (i <= both) & F.array_contains("removed", F.get("e", i - 1)) & F.array_contains("added", F.get("o", i - 1)))
    j = j.withColumn("spots", spots)
    free = lambda tokens, of: F.size(F.filter(tokens, lambda t: ~F.array_contains("spots", at(of, t).cast("int"))))
    j = j.withColumn("n_added", free(F.col("added"), F.col("o"))).withColumn("n_removed", free(F.col("removed"), F.col("e"))).withColumn("n_changed", F.size("spots"))
    survives = lambda r: F.coalesce(F.get("e", r["position"] - 1) == F.get("o", r["position"] - 1), F.lit(False))
    present = lambda r: F.array_contains("o", F.get("e", r["position"] - 1))
    needed = lambda r: r["role"].isin(*REQUIRED_ROLES)
    j = j.withColumn("lost", F.filter("roles", lambda r: ~survives(r))).withColumn("missing", F.filter("roles", lambda r: ~present(r)))
    names = lambda rows: F.transform(rows, lambda r: r["role"])
    labels = F.array_distinct(F.concat("expected", "headers"))
    count = lambda of, label: F.size(F.filter(of, lambda x: x == label))
    doubled = F.exists(labels, lambda x: (count(F.col("expected"), x) != count(F.col("headers"), x)) & (F.greatest(count(F.col("expected"), x), count(F.col("headers"), x)) > 1))
    j = j.withColumn("other_sheet", ((F.col("f") == "xlsx") & F.col("wanted_title").isNotNull() & ~F.col("wanted_title").eqNullSafe(F.col("worksheet_title"))) if sheets else F.lit(False))
    flags = {
        "column_added": F.col("n_added") > 0, "column_removed": F.col("n_removed") > 0, "column_reordered": F.col("moved") > 0,
        "header_changed_unresolved": F.col("n_changed") > 0, "duplicate_header_changed": doubled,
        "required_mapping_column_missing": F.size(F.filter("missing", needed)) > 0,
        "optional_mapping_column_missing": F.size(F.filter("missing", lambda r: ~needed(r))) > 0,
        "worksheet_identity_changed_unresolved": F.col("other_sheet"),
    }
    found = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in flags.items()]), lambda c: c.isNotNull())
    odd = (F.size("common_e") == 0) & (F.size("expected") != F.size("headers"))
    j = j.withColumn("found", found)
    last = F.when(odd | (F.size("found") == 0), F.array(F.lit("incompatible_structure"))).otherwise(F.array().cast("array<string>"))
    return j.select(
        "file_id", "profile_id", F.size("expected").alias("expected_columns"), F.size("headers").alias("observed_columns"), F.col("exact").alias("exact_positions"),
        F.col("n_changed").alias("changed"), F.col("n_added").alias("added"), F.col("n_removed").alias("removed"), "moved",
        (F.col("n_changed") + F.col("n_added") + F.col("n_removed") + F.col("moved") + F.col("other_sheet").cast("int")).alias("differences"),
        names(F.filter("lost", needed)).alias("lost_required"), names(F.filter("lost", lambda r: ~needed(r))).alias("lost_optional"), F.concat("found", last).alias("categories"),
    )


def drift_candidates(diagnostics: DataFrame, most: int = MAX_CANDIDATES) -> DataFrame:
    """The best few profiles for each file; incompatible ones only where there is no other."""
    bad = F.array_contains("categories", "incompatible_structure")
    own = Window.partitionBy("file_id")
    held = diagnostics.withColumn("__bad", bad).withColumn("__all", F.min(F.col("__bad").cast("int")).over(own)).where("not __bad or __all = 1")
    order = own.orderBy(
        F.size("lost_required"), F.size("lost_required") + F.size("lost_optional"), F.col("changed") + F.col("added") + F.col("removed"), "moved",
        F.array_contains("categories", "worksheet_identity_changed_unresolved").cast("int"), "profile_id",
    )
    return held.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).drop("__bad", "__all")


def project_roles(cells: DataFrame, columns: DataFrame) -> DataFrame:
    """Cells ``(file_id, profile_id, row_no, col_no, lexeme)`` with the role of their position."""
    chosen = columns.where("role <> 'IGNORED'").select("profile_id", F.col("position").alias("col_no"), "role")
    return cells.join(F.broadcast(chosen), ["profile_id", "col_no"])


def selector_faults(structures: DataFrame, columns: DataFrame) -> DataFrame:
    """Files whose column at a declared position has another label, or whose width differs."""
    declared = columns.groupBy("profile_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("position", "label"))), lambda x: x["label"]).alias("labels"))
    return structures.join(F.broadcast(declared), "profile_id").where(F.col("headers") != F.col("labels")).select("file_id", "profile_id")


def inconsistent_file_fields(rows: DataFrame, fields: list[str]) -> DataFrame:
    """``file_id, field`` where a one-run field takes more than one value."""
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("v")) for f in fields])
    return rows.select("file_id", F.inline(cells)).groupBy("file_id", "field").agg(F.count_distinct("v").alias("n")).where("n > 1").select("file_id", "field")


def profile_faults(columns: DataFrame, profiles: DataFrame) -> DataFrame:
    """``profile_id, fault`` of ill-formed profiles: gaps, unknown or repeated roles, no retention time or area (so without any
    column, too), and equal content under two names. Where ``profiles`` has the units, also none for the retention time, a second
    dimension's without its column or the other way round, and a height's without its column; where it has ``worksheet_title``, one outside
    workbooks. With ``set_id``, ids and contents are compared within each set, and a set of more than ``MAX_PROFILES`` is told with each of its profiles;
    without it all rows are one collection of any size."""
    held = set(profiles.columns)
    none = F.lit(None).cast("struct<position:int,role:string>")
    rows = columns.select("profile_id", F.struct(F.col("position").cast("int").alias("position"), "role").alias("c")).unionByName(profiles.select("profile_id", none.alias("c")))
    per = rows.groupBy("profile_id").agg(F.collect_list("c").alias("c"))  # a profile's columns are few
    n, positions, roles = F.size("c"), F.array_compact("c.position"), F.filter("c.role", lambda r: r != "IGNORED")
    gaps = (F.array_min(positions) != 1) | (F.array_max(positions) != n) | (F.size(F.array_distinct(positions)) != n)
    unknown = F.exists("c.role", lambda r: r.isNull() | ~r.isin("IGNORED", *ROLES))
    faults = F.array_compact(
        F.array(
            F.when(gaps, "POSITIONS_NOT_CONTIGUOUS"), F.when(F.array_max(positions) > MAX_POSITION, "POSITION_BEYOND_LIMIT"), F.when(unknown, "ROLE_UNKNOWN"),
            F.when(F.size(F.array_distinct(roles)) != F.size(roles), "ROLE_REPEATED"), *[F.when(~F.array_contains(roles, r), f"ROLE_MISSING_{r.upper()}") for r in REQUIRED_ROLES],
        )
    )
    told = per.select("profile_id", F.explode(faults).alias("fault"))
    has = lambda r: F.array_contains("roles", r)
    about = {
        "retention_time_unit": (F.trim(F.coalesce("retention_time_unit", F.lit(""))) == "", "RETENTION_TIME_UNIT_MISSING"),
        "secondary_retention_time_unit": (has("secondary_retention_time") != F.col("secondary_retention_time_unit").isNotNull(), "SECONDARY_UNIT_UNPAIRED"),
        "height_unit": (F.col("height_unit").isNotNull() & ~has("height"), "HEIGHT_UNIT_WITHOUT_COLUMN"),
        "worksheet_title": (F.col("worksheet_title").isNotNull() & (F.col("source_format") != "xlsx"), "WORKSHEET_TITLE_OUTSIDE_WORKBOOK"),
    }
    if checks := [F.when(wrong, code) for c, (wrong, code) in about.items() if c in held]:
        heads = profiles.join(per.select("profile_id", roles.alias("roles")), "profile_id")
        told = told.unionByName(heads.select("profile_id", F.explode(F.array_compact(F.array(*checks))).alias("fault")))
    # Contents, ids and sets are counted, not gathered, so a common one is in no single task.
    scope = ["set_id"] if "set_id" in held else []
    structure = ["source_format", "headers", *(["worksheet_title"] if "worksheet_title" in held else [])]
    named = profiles.select("profile_id", *scope, F.sha2(F.to_json(F.struct(*structure), {"ignoreNullFields": "false"}), 256).alias("content"))
    repeated = named.groupBy(*scope, "content").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    told = told.unionByName(named.join(repeated, [*scope, "content"], "left_semi").select("profile_id", F.lit("CONTENT_REPEATED").alias("fault")))
    again = named.groupBy(*scope, "profile_id").agg(F.count("*").alias("n")).where("n > 1")
    told = told.unionByName(again.select("profile_id", F.lit("PROFILE_ID_REPEATED").alias("fault")))
    if scope:
        large = named.groupBy("set_id").agg(F.count("*").alias("n")).where(F.col("n") > MAX_PROFILES).drop("n")
        told = told.unionByName(named.join(large, "set_id", "left_semi").select("profile_id", F.lit("SET_TOO_LARGE").alias("fault")))
    return told


def repair_profiles(profiles: DataFrame, parent_id: str, new_id: str, headers: list[str]) -> DataFrame:
    """``profiles`` and a copy of ``parent_id`` for an observed structure; the parent stays.

    Rejected where the structure is already claimed, since two owners would make it ambiguous.
    """
    parent = profiles.where(F.col("profile_id") == parent_id)
    clone = parent.withColumn("profile_id", F.lit(new_id)).withColumn("headers", F.array(*[F.lit(h) for h in headers]))
    claimed = profiles.join(clone.select("source_format", F.col("headers").alias("h")), "source_format").where("headers = h or profile_id = '" + new_id.replace("'", "''") + "'")
    if claimed.limit(1).count():
        raise ValueError("the structure or the id is already claimed")
    return profiles.unionByName(clone)


def fingerprint(content: object, tag: str) -> str:
    """SHA-256 of a tagged canonical JSON form: sorted keys, ASCII, no spaces. For configuration."""
    text = json.dumps(content, sort_keys=True, ensure_ascii=True, separators=(",", ":"))
    return hashlib.sha256(f"{tag}\n{text}".encode("ascii")).hexdigest()


def structure_fingerprint(headers: Column) -> Column:
    """A digest of observed headers, for comparing tables with one another."""
    return F.sha2(F.to_json(F.struct(headers.alias("headers"))), 256)


#: Containers' usual extensions (fixed values).
CONTAINERS = {"csv": (".csv",), "tsv": (".tsv",), "semicolon": (".txt",), "xlsx": (".xlsx",)}


def container_fits(extension: Column, source_format: Column) -> Column:
    """Whether a file's extension suits a profile's container."""
    return F.coalesce(*[F.when(source_format == f, extension.isin(*e)) for f, e in CONTAINERS.items()], F.lit(False))


def mapped_peaks(cells: DataFrame, columns: DataFrame, units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Peaks and faults of user-mapped tables.

    ``cells`` has ``file_id, profile_id, row_no, col_no, lexeme``; ``columns`` the roles by position
    and ``units (profile_id, retention_time_unit, area_unit)`` the declared units. Blank rows are
    skipped; retention time and area must be exact finite numbers; any fault fails the file.
    """
    roles = ["sample_id", "retention_time", "area", "height", "peak_number", "compound", "detector", "channel"]
    about = columns.groupBy("profile_id").agg(F.max("position").alias("width"), *[F.min(F.when(F.col("role") == r, F.col("position"))).alias(f"at_{r}") for r in roles])
    about = about.withColumn("known", F.array_compact(F.array(*[F.col(f"at_{r}") for r in roles])))
    rows = cells.groupBy("file_id", "profile_id", "row_no").agg(F.collect_list(F.struct("col_no", "lexeme")).alias("c"), F.max(F.col("lexeme") != "").alias("filled")).where("filled")
    cell = lambda at: F.when(F.col(at).isNotNull(), F.get(F.filter("c", lambda x: x["col_no"] == F.col(at)), F.lit(0))["lexeme"])
    beyond = F.exists("c", lambda x: (x["col_no"] > F.col("width")) & (x["lexeme"] != ""))
    rows = rows.join(F.broadcast(about), "profile_id").select(
        "file_id", "profile_id", "row_no", *[cell(f"at_{r}").alias(r) for r in roles], F.arrays_overlap("c.col_no", "known").alias("mapped"), F.coalesce(beyond, F.lit(False)).alias("beyond")
    )
    number = {r: L.strict_number(F.col(r), required=r in REQUIRED_ROLES) for r in ("retention_time", "area", "height")}
    text = {r: L.strict_text(F.col(r)) for r in ("sample_id", "compound", "detector", "channel")}
    # Written once: faults, their files and the peaks are all read from it.
    typed = cut(rows.where("mapped or beyond").select("file_id", "profile_id", "row_no", "mapped", "beyond", *[c.alias(r) for r, c in {**number, **text}.items()], L.strict_integer(F.col("peak_number")).alias("peak_number")))
    checked = [*number, *text, "peak_number"]
    codes = {r: F.col(r)["code"] for r in checked}
    faulty = typed.where(F.col("mapped") & F.coalesce(*codes.values()).isNotNull())
    pairs = F.array_compact(F.array(*[F.when(c.isNotNull(), F.struct(F.lit(r).alias("field"), c.alias("code"))) for r, c in codes.items()]))
    extra = typed.where("beyond").select("file_id", "row_no", F.lit(None).cast("string").alias("field"), F.lit("PEAK_MAPPING_EXTRA_CELLS").alias("code"))
    rows_of = typed.where("mapped")
    empty = cells.select("file_id").distinct().join(rows_of.select("file_id").distinct(), "file_id", "left_anti").select("file_id", F.lit(None).cast("int").alias("row_no"), F.lit(None).cast("string").alias("field"), F.lit("PEAK_MAPPING_EMPTY_TABLE").alias("code"))
    faults = faulty.select("file_id", "row_no", F.inline(pairs)).unionByName(extra).unionByName(empty)
    bad = faulty.select("file_id").union(typed.where("beyond").select("file_id")).distinct()
    good = rows_of.join(bad, "file_id", "left_anti").join(F.broadcast(units), "profile_id")
    order = F.row_number().over(Window.partitionBy("file_id", F.col("detector")["value"], F.col("channel")["value"]).orderBy("row_no"))
    peaks = good.select("file_id", "profile_id", "row_no", *[F.col(r)["value"].alias(r) for r in checked], "retention_time_unit", "area_unit", order.alias("observation_order"))
    return peaks, faults


def mapping_provenance(peaks: DataFrame, profiles: DataFrame, columns: DataFrame) -> DataFrame:
    """``file_id, key, value`` facts on how a mapped file was read."""
    about = columns.groupBy("profile_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("role") != "IGNORED", F.struct("position", "role")))), lambda x: x["role"]), ";").alias("roles"),
        F.count_if(F.col("role") == "IGNORED").alias("ignored"),
    )
    rows = peaks.groupBy("file_id", "profile_id").agg(F.count("*").alias("rows")).join(F.broadcast(about), "profile_id").join(F.broadcast(profiles.select("profile_id", "source_format")), "profile_id")
    facts = {"mapping_mode": F.lit("user_profile"), "mapping_profile_id": F.col("profile_id"), "source_format": F.col("source_format"), "mapped_roles": F.col("roles"), "ignored_columns": F.col("ignored").cast("string"), "mapped_rows": F.col("rows").cast("string")}
    return rows.select("file_id", F.inline(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in facts.items()])))


def unused_mapping_notices(routes: DataFrame) -> DataFrame:
    """A notice for each file that a profile fits but an exact reader owns."""
    return routes.where("adapter is not null and profile_id is not null").select("file_id", F.lit("MAPPING_NOT_APPLIED").alias("code"), F.lit("warning").alias("severity"))
