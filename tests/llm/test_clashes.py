"""Tables whose extra columns have the names that the operators use inside."""

from __future__ import annotations

import pytest

from tallyloom.llm import chains, decontaminate, language, lines, packing, phrases, quality, secrets, simhash, suffixes, tokenfiles, toxicity
from tallyloom.llm.common import free_names

NAMES = (
    "__d", "__doc", "__gone", "__exact", "__lines", "__hit", "__key", "__spans", "__leads", "__pieces", "__cut", "__first", "__guess", "__hot", "__n", "salt", "digest", "copies", "text_key", "node", "spans",
    "items", "score", "words", "h", "g", "k", "phrase", "cut", "piece", "start", "n_exact", "group", "arrival", "host", "host_key", "bag", "mark", "toxic",
)
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda my nu xi omikron pi rho sigma tau ypsilon"


@pytest.fixture(scope="module")
def clashing(spark):
    bench = " ".join(f"bench{i}" for i in range(12))
    rows = [(i, f"{WORDS} number {i} {WORDS}\nshared line of some words here\npassword = hunter{i}x9", "en" if i % 2 else "de", f"src{i % 2}") for i in range(6)]
    rows += [(10, f"{WORDS} {bench} {WORDS}", "en", "src0"), (11, None, None, None), (None, rows[0][1], "de", "src0"), (1, rows[1][1], "en", "src1")]
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{n}` string" for n in NAMES)
    docs = spark.createDataFrame([(*r, *(f"{n}!" for n in NAMES)) for r in rows], schema)
    return docs, spark.createDataFrame([("item", bench)], "item_id string, text string")


def test_filters_keep_all_columns_as_they_are(spark, clashing):
    docs, bench = clashing
    made = {
        "lines": lines.dedup_lines(docs), "documents": decontaminate.remove_documents(docs, bench), "spans": decontaminate.remove_spans(docs, bench), "near": simhash.drop_near_duplicates(docs),
        "redact": secrets.redact(docs), "language": language.keep_identified(docs),
    }
    for name, out in made.items():
        kept = [n for n in NAMES if not (name == "lines" and n == "n_exact")]
        rows = out.collect()
        assert rows and set(docs.columns) <= set(out.columns), name
        assert all(r[n] == f"{n}!" for r in rows for n in kept), name
    assert {r["doc_id"] for r in made["documents"].collect()} == {*range(6), 11, None}
    assert "hunter" not in " ".join(r["text"] or "" for r in made["redact"].collect())


def test_reports_read_their_own_columns_alone(spark, clashing):
    docs, bench = clashing
    n = docs.count()
    labels = spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id long, toxic int")
    assert lines.line_digest(docs).count() == n and quality.quality_verdicts(docs).count() == n and simhash.simhash_classes(docs).count() == n
    assert decontaminate.contamination_digest(docs, bench).where("contaminated").count() == 1 and secrets.secret_digest(docs).count() == n
    assert language.identify_languages(docs).count() == n and toxicity.score_toxicity(docs, labels).count() == n
    assert packing.pack_documents(docs).count() == n and tokenfiles.token_file_digest(docs).count() == n
    assert suffixes.repeated_passages(docs).count() >= 0 and chains.fuzzy_passages(docs).count() >= 0 and phrases.collocations(docs, min_count=2).count() > 0


def test_free_names(spark):
    df = spark.createDataFrame([(1, 2)], "A int, a_ int")
    assert free_names(df, "a", "b", "b") == ["a__", "b", "b_"]
