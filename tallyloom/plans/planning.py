"""Dry-run plans: entries, problems, readiness, digests and comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators import merkle
from tallyloom.operators import summary as M
from tallyloom.operators.mapping import fingerprint
from tallyloom.plans.recipes import Recipe  # noqa: F401

#: Most files and bytes of one plan (fixed values).
MAX_PLAN_FILES = 10_000
MAX_PLAN_BYTES = 64 << 30
#: The reader of plain delimited tables.
GENERIC = "delimited"


def plan_entries(files: DataFrame, routes: DataFrame) -> DataFrame:
    """``file_id, relative_path, size, sha256, status, route, problem, adapter``: routing only, no parsing.

    ``routes`` has ``file_id, adapter, code`` and, where profiles were asked for, ``mapping_route``. Routes and problems
    have the names that ``summary.plan_problem`` and ``summary.plan_counts`` have.
    """
    asked = "mapping_route" in routes.columns
    mapping = F.col("mapping_route") if asked else F.lit(None).cast("string")
    joined = files.join(routes.select("file_id", "adapter", "code", *(["mapping_route"] if asked else [])), "file_id", "left")
    taken = F.coalesce(mapping.isin("USER_MAPPING", "USER_MAPPING_PROFILE"), F.lit(False))
    status = (
        F.when(F.col("excluded"), "EXCLUDED_ARTIFACT").when(F.col("duplicate_of").isNotNull(), "DUPLICATE")
        .when(F.col("code").isNull() & (F.col("adapter").isNotNull() | taken), "ROUTABLE").otherwise("FAILED")
    )
    route = F.when(status != "ROUTABLE", None).when(taken, mapping).when(F.col("adapter") == GENERIC, "GENERIC_INPUT").otherwise("EXACT_ADAPTER")
    lost = F.col("sha256").isNull() & F.col("code").isNull()
    told = F.when(lost, "INPUT_DISCOVERY_FAILED").otherwise(M.plan_problem(mapping, F.coalesce("code", F.lit("FORMAT_NOT_DETECTED")), F.col("relative_path")))
    problem = F.when(status == "FAILED", told).when(status == "DUPLICATE", "DUPLICATE_INPUT")
    return joined.select("file_id", "relative_path", "size", "sha256", status.alias("status"), route.alias("route"), problem.alias("problem"), "adapter")


def plan_limit(files: DataFrame, most_files: int = MAX_PLAN_FILES, most_bytes: int = MAX_PLAN_BYTES) -> str | None:
    """The code of the first limit that a plan's files break, or None."""
    seen = files.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()
    return "PLAN_FILE_LIMIT_EXCEEDED" if seen["n"] > most_files else "PLAN_SIZE_LIMIT_EXCEEDED" if seen["size"] > most_bytes else None


def summarise_plan(entries: DataFrame) -> DataFrame:
    """One row: the fourteen counters of ``summary.plan_counts``, ``total_bytes`` and ``readiness``."""
    size = entries.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total_bytes")).first()["total_bytes"]
    ready = F.when(F.col("routable") == 0, "BLOCKED").when(F.col("failed") > 0, "READY_WITH_KNOWN_FAILURES").otherwise("READY")
    return M.plan_counts(entries).withColumns({"total_bytes": F.lit(size).cast("long"), "readiness": ready})


def plan_digest(entries: DataFrame, options: dict) -> str:
    """A digest of a plan: order-free over its entries, and its options."""
    nodes = merkle.tree(entries, F.col("file_id").cast("string"), merkle.row_digest(sorted(entries.columns)))
    return fingerprint({"entries": merkle.root(nodes), "options": options}, "tallyloom-plan-2")


def plan_changes(reviewed: DataFrame, rebuilt: DataFrame, range_rows: int = merkle.RANGE_ROWS) -> DataFrame:
    """``file_id, change, a, b``: entries that were added, removed or changed since a plan was reviewed. Digest
    trees tell which ranges of entries differ, and only those are compared."""
    return merkle.changes(reviewed, rebuilt, "file_id", [c for c in reviewed.columns if c != "file_id"], range_rows)
