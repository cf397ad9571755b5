"""Routing files to readers: probes, best route, profiles, privacy."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Two claims closer than this are ambiguous (fixed value; compared in double arithmetic).
AMBIGUITY_MARGIN = 0.05


@dataclass(frozen=True)
class Rule:
    """A reader's claim on a file: whether it matches, how surely, and whether it is private."""

    adapter: str
    matched: Column
    confidence: Column
    private: bool = False
    reason: str = ""


def graded(exact: Column, family: Column, exact_score: float = 0.99, family_score: float = 0.70) -> Column:
    """Confidence of a rule that owns a family but reads only its exact form; null without a match."""
    return F.when(exact, exact_score).when(family, family_score)


def graded_probes(rules: list[Rule]) -> Column:
    """The claims of all rules on a file as an array; a missing claim counts as none."""
    rows = [
        F.struct(
            F.lit(r.adapter).alias("adapter"), F.coalesce(r.matched, F.lit(False)).alias("matched"),
            F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(r.confidence.cast("double"), F.lit(0.0)))).alias("confidence"),
            F.lit(r.private).alias("private"), F.lit(r.reason).alias("reason"),
        )
        for r in rules
    ]
    return F.array(*rows)


def probe_matrix(files: DataFrame, rules: list[Rule]) -> DataFrame:
    """``file_id, adapter, matched, confidence, private, reason`` for each file and rule."""
    return files.select("file_id", F.inline(graded_probes(rules)))


def best_routes(files: DataFrame, probes: DataFrame, forced: str | None = None) -> DataFrame:
    """``file_id, adapter, confidence, code`` for each file.

    Where a private rule matches, only private rules compete. The surest match wins unless the next
    one is within the margin (``FORMAT_AMBIGUOUS``); no match is ``FORMAT_NOT_DETECTED``.
    """
    hits = probes.where("matched")
    if forced:
        hits = hits.where(F.col("adapter") == forced)
    own = Window.partitionBy("file_id")
    hits = hits.withColumn("__any", F.max("private").over(own)).where("private or not __any")
    order = own.orderBy(F.desc("confidence"), "adapter")
    top = hits.select("file_id", "adapter", "confidence", F.row_number().over(order).alias("r"), F.lead("confidence").over(order).alias("second")).where("r = 1")
    close = F.col("confidence") - F.col("second") <= AMBIGUITY_MARGIN
    joined = files.select("file_id").join(top, "file_id", "left")
    code = F.when(F.col("adapter").isNull(), "FORMAT_NOT_DETECTED").when(close, "FORMAT_AMBIGUOUS")
    return joined.select("file_id", F.when(code.isNull(), F.col("adapter")).alias("adapter"), F.when(code.isNull(), F.col("confidence")).alias("confidence"), code.alias("code"))


def profile_matches(structures: DataFrame, profiles: DataFrame) -> DataFrame:
    """``file_id, profile_id, n_profiles, code`` of files whose headers equal a profile's.

    ``structures`` has ``file_id, source_format, headers``. Exactly one match is taken; several are
    ``AMBIGUOUS_MAPPING_PROFILE``, none leaves the profile null. Profiles are few (32 at most).
    """
    p = profiles.select("profile_id", F.col("source_format").alias("f"), F.col("headers").alias("h"))
    hits = structures.join(F.broadcast(p), (F.col("source_format") == F.col("f")) & (F.col("headers") == F.col("h")), "left")
    n = hits.groupBy("file_id").agg(F.count("profile_id").alias("n_profiles"), F.min("profile_id").alias("profile_id"))
    return n.select("file_id", F.when(F.col("n_profiles") == 1, F.col("profile_id")).alias("profile_id"), "n_profiles", F.when(F.col("n_profiles") > 1, "AMBIGUOUS_MAPPING_PROFILE").alias("code"))


def classify_routes(routes: DataFrame, matches: DataFrame, drift: DataFrame, single_mapping: bool = False) -> DataFrame:
    """``file_id, route``: an exact reader first, then profiles, then what is left of them."""
    joined = routes.join(matches.select("file_id", "profile_id", "n_profiles"), "file_id", "left").join(drift.select("file_id").distinct().withColumn("drifts", F.lit(True)), "file_id", "left")
    route = (
        F.when(F.col("adapter").isNotNull(), "EXACT_ADAPTER")
        .when(F.lit(single_mapping) & F.col("profile_id").isNotNull(), "USER_MAPPING")
        .when(F.col("profile_id").isNotNull(), "USER_MAPPING_PROFILE")
        .when(F.col("n_profiles") > 1, "AMBIGUOUS_MAPPING_PROFILE")
        .when(F.col("drifts"), "SCHEMA_DRIFT_CANDIDATE")
        .otherwise("NO_MAPPING_MATCH")
    )
    return joined.select("file_id", "adapter", "profile_id", route.alias("route"))


def private_files(files: DataFrame, suffix_rules: DataFrame, routes: DataFrame, mapping_requested: bool = False) -> DataFrame:
    """``file_id, private``: a private rule owns the suffix, or a mapping is asked for; a public rule
    that reads the file restores its path."""
    owned = suffix_rules.groupBy("suffix").agg(F.bool_or("private").alias("owned"))
    joined = files.join(F.broadcast(owned), files["extension"] == owned["suffix"], "left").join(routes.select("file_id", F.col("private").alias("by_rule")), "file_id", "left")
    private = F.when(F.col("by_rule").isNotNull(), F.col("by_rule")).otherwise(F.coalesce("owned", F.lit(False)) | F.lit(mapping_requested))
    return joined.select("file_id", private.alias("private"))


def public_view(rows: DataFrame) -> DataFrame:
    """Path columns replaced by the public reference where a row has a ``public_id``."""
    hide = F.col("public_id").isNotNull()
    return rows.withColumns({c: F.when(hide, F.col("public_id")).otherwise(F.col(c)) for c in ("path", "relative_path", "name") if c in rows.columns})


def has_marker(content: Column, marker: bytes, within: int = 65_536) -> Column:
    """Whether the first bytes of a file hold a marker."""
    return F.contains(F.substring(content, 1, within), F.unhex(F.lit(marker.hex())))


def knows_headers(headers: Column, markers: list[str], least: int, rare: str) -> Column:
    """Whether a header list holds ``least`` known labels or more, the ``rare`` one among them."""
    known = F.array(*[F.lit(m) for m in markers])
    return (F.size(F.array_intersect(headers, known)) >= least) & F.array_contains(headers, rare)
