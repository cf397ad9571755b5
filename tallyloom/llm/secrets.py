"""Secret scans: all rules in one byte pass of a combined minimal automaton.

The automaton, built on the driver from the rules' regexes, tells which stretches of a batch of
texts hold a match of any rule. Only those stretches go through the single regexes, for the exact
spans.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .automaton import compile_search, flagged_stretches
from .common import chunks, free_names, joined


@dataclass(frozen=True)
class Rule:
    """``search`` is what the automaton looks for, ``exact`` gives spans (leftmost, not
    overlapping), ``keep`` drops the matches that are too short."""

    kind: str
    search: bytes
    exact: bytes
    least: tuple[int, int] = (0, 0)  # (group, bytes)

    def spans(self, pattern: re.Pattern, data: bytes):
        group, size = self.least
        for m in pattern.finditer(data):
            if len(m[group]) >= size:
                yield m.start(), m.end()


_KEYWORD = rb"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?"
#: Base rules in the order in which equal starts are listed, then further kinds.
RULES = (
    Rule("assign", _KEYWORD + rb"[A-Za-z0-9+/_.=-]{6}", _KEYWORD + rb"([A-Za-z0-9+/_.=-]+)", (2, 6)),
    Rule("access", rb"AKIA[A-Z0-9]{16}", rb"AKIA[A-Z0-9]+", (0, 20)),
    Rule("hex", rb"[0-9a-f]{24}", rb"[0-9a-f]+", (0, 24)),
    Rule("pem", rb"-----BEGIN [A-Z ]*PRIVATE KEY-----", rb"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge", rb"gh[opsru]_[A-Za-z0-9]{8}", rb"gh[opsru]_[A-Za-z0-9]{36,}"),
    Rule("chat", rb"xox[abprs]-[A-Za-z0-9-]{10}", rb"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", rb"eyJ[A-Za-z0-9_-]{8}", rb"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*"),
)
BASE_KINDS = ("assign", "access", "hex")
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def secret_spans(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Array of ``(kind, start, end)`` in code points, by start and then rule order; never null."""
    auto = compile_search([r.search for r in rules])

    @F.arrow_udf("array<struct<kind:string,start:long,end:long>>")
    def scan(texts: pa.Array) -> pa.Array:
        exact = [re.compile(r.exact) for r in rules]
        found: list[list[dict]] = [[] for _ in range(len(texts))]
        for first, part in chunks(texts.cast(pa.binary()).to_pylist()):
            data, starts = joined(part)
            raw = data.tobytes()
            hits: list[tuple[int, int, int]] = []
            for begin, end in flagged_stretches(auto, data):
                stretch = raw[begin:end]
                for k, rule in enumerate(rules):
                    hits += [(begin + s, k, begin + e) for s, e in rule.spans(exact[k], stretch)]
            for s, k, e in sorted(hits):
                i = int(np.searchsorted(starts, s, side="right")) - 1
                text_bytes, base = part[i], int(starts[i])
                start = len(text_bytes[: s - base].decode("utf-8", "replace"))
                found[first + i].append({"kind": rules[k].kind, "start": start, "end": start + (e - s)})
        return pa.array(found, pa.list_(_SPAN))

    return scan(text)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id, found`` for each row: the secrets' spans in the whole text.

    Null and empty texts have none. Repeated rows each get a row and null ids stay null. Other
    columns are not read. An empty table gives an empty result.
    """
    return docs.select(F.col(id_col).alias("doc_id"), secret_spans(F.col(text_col), rules).alias("found"))


def secret_digest(docs: DataFrame, **options) -> DataFrame:
    """Counts by base kind, a digest of the base spans and all spans as text."""

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("found", lambda s: s["kind"].isin(*BASE_KINDS))
    return find_secrets(docs, **options).select(
        "doc_id", *[count(k) for k in BASE_KINDS], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans")
    )


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[secret]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with each secret replaced by ``mask``; overlapping spans are replaced together.

    Null and empty texts stay as they are; all rows and columns stay; an empty table stays empty.
    """
    (own,) = free_names(docs, "__spans")
    spans = docs.withColumn(own, secret_spans(F.col(text_col), rules))
    text = F.col(text_col)

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
        fresh = s["start"] >= acc["at"]
        return F.struct(
            F.when(fresh, F.concat(acc["out"], gap, F.lit(mask))).otherwise(acc["out"]).alias("out"),
            F.greatest(acc["at"], s["end"].cast("int")).alias("at"),
        )

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    whole = F.aggregate(own, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return spans.select(*[F.when(F.size(own) == 0, text).otherwise(whole).alias(c) if c == text_col else F.col(c) for c in docs.columns])
