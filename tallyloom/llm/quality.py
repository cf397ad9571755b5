"""Host-level quality rules: rule failures by domain, rates shrunk with an empirical beta prior.

DataFrame functions only. Features come from one pass over whole texts; only their figures are
written and aggregated by host, so a host with a third of all rows costs no more than others. Each
rule has its own prior, fitted to the hosts' counts with the noise of small hosts taken out. A host
whose documents mostly fail goes as a whole; a host that surely fails a rule far more often than
hosts do loses those documents that fail it, where other hosts keep theirs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, cut, let, spread, words_column

SYMBOLS = "#*$%&|<>"
#: The strength of a prior whose hosts don't differ beyond the noise of their numbers.
NO_SPREAD = 1000.0


def repeated_words(words: Column, width: int = 3) -> Column:
    """Words that stand in a ``width``-word window found twice or more, the first one included.

    Windows are told apart by a 64-bit hash of their words.
    """
    def window(i: Column) -> Column:
        return F.struct(F.xxhash64(*[F.get(words, i + k) for k in range(width)]).alias("h"), i.alias("i"))

    def positions(s: Column) -> Column:
        def twice(x: Column, k: Column) -> Column:
            return F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))

        return F.transform(F.filter(s, twice), lambda x: x["i"])

    def covered(acc: Column, i: Column) -> Column:
        return F.struct((i + width).alias("end"), (acc["n"] + (i + width - F.greatest(acc["end"], i))).alias("n"))

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - width), window)
    spots = F.sort_array(let(F.sort_array(windows), positions))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    return F.when(F.size(words) > width, F.aggregate(spots, start, covered)["n"]).otherwise(0).cast("long")


def text_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """``doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` for each row."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = base.withColumn("words", words_column(F.col("text")))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    return base.select(
        "doc_id", "host",
        F.size("words").cast("long").alias("n_words"),
        F.aggregate("words", F.lit(0).cast("long"), lambda n, w: n + F.length(w)).alias("word_chars"),
        F.length(F.regexp_replace("text", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
    )


def rule_failures() -> dict[str, Column]:
    """The rules that count towards a host's rate, as conditions on the features."""
    n = F.col("n_words")
    return {
        "short": n < 50,
        "repetitive": 100 * F.col("n_repeat_words") > 50 * n,
        "symbols": 10 * F.col("n_symbols") > n,
        "word_length": (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 12 * n),
    }


def beta_prior(hosts: DataFrame, failed: list[str], strength: tuple[float, float] = (2.0, NO_SPREAD)) -> dict[str, tuple[float, float]]:
    """``(mean, strength)`` of a beta prior for each column of failure counts in ``hosts``.

    By moments of the beta-binomial: the hosts' rates vary by the prior's spread and by the noise of
    their own numbers, which is taken off; what is left gives the strength, held within bounds. The
    mean is that of all documents.
    """
    n = F.col("n_docs")
    sums = hosts.agg(
        F.count("*").alias("k"), F.sum(n).alias("n"), F.sum((n * n).cast("double")).alias("nn"),
        *[F.sum(c).alias(f"x_{c}") for c in failed], *[F.sum(F.col(c).cast("double") * F.col(c) / n).alias(f"xx_{c}") for c in failed],
    ).first()
    out = {}
    for c in failed:
        m = (sums[f"x_{c}"] or 0) / sums["n"] if sums["n"] else 0.0
        noise, spread = m * (1 - m), 0.0
        free = sums["n"] - sums["nn"] / sums["n"] - (sums["k"] - 1) if sums["n"] else 0
        if noise > 0 and free > 0:
            spread = round(((sums[f"xx_{c}"] - m * m * sums["n"]) / noise - (sums["k"] - 1)) / free, 6)
        out[c] = (m, min(max(1 / spread - 1, strength[0]), strength[1]) if spread > 0 else strength[1])
    return out


def host_verdicts(flagged: DataFrame, max_rate: float = 0.5, ratio: float = 1.5, sureness: float = 1.645) -> DataFrame:
    """``host_key, n_docs, rate, host_kept, strict_<rule>...`` from rows with ``host_key`` and flags.

    A host's rates are posterior means, so a host with few documents stays near the prior. It is
    kept as a whole while at most ``max_rate`` of its documents fail any rule. It is strict in a rule
    where hosts differ beyond the noise of their numbers at all, and where its rate is over ``ratio`` times the
    prior's mean with 95 percent of its posterior: by ``sureness`` posterior standard deviations, as the normal law
    has it (for rates below a half that asks for more than the beta law does). Null flags count as no failure; an
    empty table has no hosts.
    """
    failed = [c for c in flagged.columns if c.startswith("failed_")]
    hosts = cut(flagged.groupBy("host_key").agg(F.count("*").alias("n_docs"), *[F.sum(F.col(c).cast("long")).alias(c) for c in failed]))
    prior = beta_prior(hosts, failed)

    def rate(c: str) -> Column:
        m, s = prior[c]
        return (F.col(c) + F.lit(m * s)) / (F.col("n_docs") + F.lit(s))

    def surely_over(c: str) -> Column:
        m, s = prior[c]
        low = rate(c) - F.lit(sureness) * F.sqrt(rate(c) * (1 - rate(c)) / (F.col("n_docs") + F.lit(s + 1)))
        return F.lit(s < NO_SPREAD) & (low > F.lit(ratio * m))

    strict = [surely_over(c).alias(c.replace("failed_", "strict_", 1)) for c in failed if c != "failed_any"]
    return hosts.select("host_key", "n_docs", rate("failed_any").alias("rate"), (rate("failed_any") <= max_rate).alias("host_kept"), *strict)


def quality_verdicts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_rate: float = 0.5, ratio: float = 1.5, sureness: float = 1.645, max_broadcast_bytes: int = 64_000_000
) -> DataFrame:
    """Features, ``base_failed``, the host's shrunk failure rate and ``kept`` for each document.

    A document is kept unless it fails the base rules (under 50 words, or over half of its words in
    repeated 3-word windows), its host goes as a whole, or it fails a rule in which its host is
    strict (see ``host_verdicts``). Null and empty texts have no words and fail. A null host is a
    host of its own. Repeated rows each get a row. An empty table gives an empty result; other
    columns are not read. The verdicts are broadcast where they are within ``max_broadcast_bytes``;
    otherwise they are joined by a shuffle in which hot hosts are salted.
    """
    rules = rule_failures()
    flagged = text_features(docs, id_col, text_col, host_col)
    flagged = flagged.withColumn("host_key", F.coalesce(F.concat(F.lit("h"), F.col("host").cast("string")), F.lit("null")))
    flagged = flagged.select("*", *[c.alias(f"failed_{k}") for k, c in rules.items()])
    flagged = cut(flagged.withColumn("failed_any", F.expr(" or ".join(f"failed_{k}" for k in rules))))
    verdicts = host_verdicts(flagged, max_rate, ratio, sureness)
    size = verdicts.agg(F.sum(F.octet_length("host_key") + 64)).first()[0] or 0
    if size <= max_broadcast_bytes:
        joined = flagged.join(F.broadcast(verdicts), "host_key")
    else:
        left, right = spread(flagged, verdicts, "host_key", "n_docs", flagged.count(), ["doc_id", "n_words", "word_chars"])
        joined = left.join(right, ["host_key", "salt"]).drop("salt")
    base_failed = F.col("failed_short") | F.col("failed_repetitive")
    condemned = F.expr(" or ".join(f"failed_{k} and strict_{k}" for k in rules))
    return joined.withColumn("base_failed", base_failed).withColumn("kept", ~base_failed & F.col("host_kept") & ~condemned).drop("host_key", "n_docs")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, row_number() OVER () AS r, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT r, i, array_to_string(list_slice(w, i, i + 2), ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 3)),
k AS (SELECT r, g FROM t GROUP BY r, g HAVING count(*) > 1),
c AS (SELECT r, count(DISTINCT x) AS n FROM (SELECT t.r, unnest(range(i, i + 3)) AS x FROM t JOIN k ON t.r = k.r AND t.g = k.g) GROUP BY r),
l AS (SELECT r, count(*) - count(DISTINCT x) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY r),
f AS (
  SELECT d.doc_id, d.source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(l.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN c ON d.r = c.r LEFT JOIN l ON d.r = l.r),
g AS (
  SELECT *, n_words < 50 AS f1, 100 * n_repeat_words > 50 * n_words AS f2, 10 * n_symbols > n_words AS f3,
    word_chars < 2 * n_words OR word_chars > 12 * n_words AS f4 FROM f),
r AS (SELECT *, unnest([1, 2, 3, 4, 0]) AS rule, unnest([f1, f2, f3, f4, f1 OR f2 OR f3 OR f4]) AS bad FROM g),
h AS (SELECT rule, source, count(*) AS n, count(*) FILTER (WHERE bad) AS x FROM r GROUP BY rule, source),
m AS (SELECT rule, count(*) AS k, sum(n) AS n, sum(CAST(n AS DOUBLE) * n) AS nn, sum(x) / sum(n) AS m, sum(CAST(x AS DOUBLE) * x / n) AS xx FROM h GROUP BY rule),
v AS (
  SELECT rule, m, CASE WHEN m * (1 - m) > 0 AND n - nn / n - (k - 1) > 0 THEN round(((xx - m * m * n) / (m * (1 - m)) - (k - 1)) / (n - nn / n - (k - 1)), 6) ELSE 0 END AS rho FROM m),
p AS (SELECT rule, m, CASE WHEN rho > 0 THEN least(greatest(1 / rho - 1, 2.0), 1000.0) ELSE 1000.0 END AS s FROM v),
w AS (
  SELECT h.source, h.rule, (h.x + p.m * p.s) / (h.n + p.s) AS rate, h.n, p.m, p.s FROM h JOIN p ON h.rule = p.rule),
u AS (SELECT *, s < 1000.0 AND rate - 1.645 * sqrt(rate * (1 - rate) / (n + (s + 1))) > 1.5 * m AS strict FROM w),
z AS (
  SELECT source, bool_or(rule = 0 AND rate > 0.5) AS gone, bool_or(rule = 3 AND strict) AS s3, bool_or(rule = 4 AND strict) AS s4 FROM u GROUP BY source)
SELECT g.doc_id, g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words, (f1 OR f2) AS base_failed,
  NOT (f1 OR f2 OR z.gone OR (f3 AND z.s3) OR (f4 AND z.s4)) AS kept
FROM g JOIN z ON g.source IS NOT DISTINCT FROM z.source
"""
