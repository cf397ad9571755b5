"""op5 and the near-duplicate stage: tables whose variants are inlined are never broadcast, however small Spark takes them for."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tallyloom.llm import simhash


def test_inlined_variants_are_not_broadcast(spark):
    nodes = spark.createDataFrame([(1, 0), (2, 1), (3, 1 << 40), (4, -1)], "node long, fp long")
    like = lambda a, b: F.bit_count(a("fp").bitwiseXOR(b("fp"))) <= 4
    once = lambda a, b: simhash.first_meeting(a("fp"), b("fp"), a("segment"), 4)
    for sparse, keys in ((False, simhash.variants(F.col("fp"), 4)), (True, F.col("keys"))):
        held = nodes.withColumn("keys", simhash.variants(F.col("fp"), 4)) if sparse else nodes
        plans = []
        verify = lambda pairs: plans.append(pairs._jdf.queryExecution().executedPlan().toString()) or pairs  # noqa: E731, B023
        roots = {r["node"]: r["root"] for r in simhash._link(held, ["fp"], keys, like, once, verify, 32, sparse).collect()}
        assert roots == {1: 1, 2: 1, 3: 1}
        assert re.search(r"SortMergeJoin \[key#\d+L\], \[p_key#", plans[0]) and re.search(r"SortMergeJoin \[a_key#\d+L\], \[b_key#", plans[1])
        if sparse:
            assert all(re.search(r"SortMergeJoin \[node#\d+L\], \[node#", p) for p in plans)
