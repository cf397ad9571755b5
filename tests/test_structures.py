"""Digest trees, joins under skew, canonical JSON and fingerprints, sheets, wide integers, streamed files."""

from __future__ import annotations

import hashlib
import json
import random
import subprocess
import sys
import textwrap

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import canonical
from tallyloom.functions import lexemes as L
from tallyloom.operators import fingerprints, joins, mapping, merkle, series, sheets
from tallyloom.operators import tables as P
from tallyloom.sources import delimited, scan

# -- files as streams ------------------------------------------------------------------------


def write(folder, name: str, data: bytes) -> None:
    (folder / name).write_bytes(data)


def test_streamed_cells_take_back_files_with_late_faults(spark, tmp_path):
    write(tmp_path, "a.csv", b'\xef\xbb\xbfrt,area\r\n1,"2,5"\r\n\r\n3,"x\ny"\r\n')
    write(tmp_path, "b.csv", b"h\n" + b"1\n" * 60_000 + b'"open')
    write(tmp_path, "c.tsv", b"h\n" + b"1\n" * 60_000 + b"\xff\n")
    write(tmp_path, "d.txt", b"a;b\n1;\x00\n")
    write(tmp_path, "e.csv", b"")
    write(tmp_path, "f.txt", b"a;b\n1;2;3\n")
    sources = scan.discover(spark, [str(tmp_path)])
    names = {r["file_id"]: r["name"] for r in sources.collect()}
    empty = spark.createDataFrame([(99, str(tmp_path / "e.csv"), ".csv")], "file_id long, path string, extension string")  # Spark lists no empty files
    names[99] = "e.csv"
    rows = delimited.stream_cells(sources.select("file_id", "path", "extension").unionByName(empty)).collect()
    errors = {names[r["file_id"]]: r["error"] for r in rows if r["error"]}
    assert errors == {"b.csv": "DELIMITED_SYNTAX_INVALID", "c.tsv": "INVALID_UTF8", "d.txt": "NUL_BYTE", "e.csv": "EMPTY_FILE"}
    assert {names[r["file_id"]] for r in rows if not r["error"]} == {"a.csv", "f.txt"}
    cells = {(r["row_no"], r["col_no"]): r["lexeme"] for r in rows if names[r["file_id"]] == "a.csv"}
    assert cells == {(0, 1): "rt", (0, 2): "area", (1, 1): "1", (1, 2): "2,5", (3, 1): "3", (3, 2): "x\ny"}
    gone = spark.createDataFrame([(1, str(tmp_path / "none.csv"), ".csv")], "file_id long, path string, extension string")
    assert [r["error"] for r in delimited.stream_cells(gone).collect()] == ["FILE_MISSING"]
    hashes = {r["path"].rsplit("/", 1)[-1]: r["sha256"] for r in scan.with_hash(sources).collect()}
    assert hashes == {p.name: hashlib.sha256(p.read_bytes()).hexdigest() for p in tmp_path.iterdir() if p.name != "e.csv"}
    assert hashes == {r["path"].rsplit("/", 1)[-1]: r["sha256"] for r in scan.with_hash(sources, [str(tmp_path)]).collect()}


def test_previews_read_the_first_rows_only(spark, tmp_path):
    write(tmp_path, "a.csv", b"rt,area\n,\n1,2\n3,4\n5,6\n" + b'"broken')
    sources = scan.discover(spark, [str(tmp_path)])
    assert [(r["row_no"], r["cells"]) for r in scan.preview_files(sources, 2).orderBy("row_no").collect()] == [(0, ["rt", "area"]), (2, ["1", "2"]), (3, ["3", "4"])]
    with pytest.raises(ValueError):
        scan.preview_files(sources, 11)


def test_cells_as_a_data_source(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    write(tmp_path, "b.tsv", b"x\ty\n1\t2\n")
    write(tmp_path, "a.csv", b"x,y\n" + b"1,2\n" * 100)
    write(tmp_path / "sub", "c.csv", b"z\n")
    write(tmp_path, "_hidden.csv", b"z\n")
    delimited.register(spark)
    read = lambda **o: spark.read.format("delimited_cells").options(**o).load(str(tmp_path))
    assert read().count() == 202 + 4 and read(recursive="true").where("lexeme = 'z'").count() == 1
    assert read(rows="3").groupBy("file_id").count().orderBy("file_id").collect() == [(1, 8), (2, 4)]
    assert {r["lexeme"] for r in read(delimiter=";").where("file_id = 1 and row_no = 0").collect()} == {"x,y"}


def test_a_file_of_200_mb_takes_little_memory(tmp_path):
    """The reader alone, in a process of its own: under 1 GB, of which the libraries take some."""
    path = tmp_path / "large.csv"
    line = ",".join("v" * 198 for _ in range(5)) + "\n"
    path.write_text("a,b,c,d,e\n" + line * (200_000_000 // len(line)))
    code = f"""
        import resource, sys
        sys.path.insert(0, {str(sys.path[0])!r})
        from tallyloom.sources.delimited import file_cells
        print(sum(b.num_rows for b in file_cells(1, {str(path)!r}, ",")), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss)
    """
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], capture_output=True, text=True, check=True, cwd=str(tmp_path), env={"PYTHONPATH": ":".join(sys.path)})
    n, kb = map(int, done.stdout.split())
    assert n == 5 * (200_000_000 // len(line) + 1) and kb < 1_000_000


# -- digest trees ----------------------------------------------------------------------------


def test_trees_tell_two_ranges_of_a_million(spark):
    rows = spark.range(1_000_000).select(F.col("id").cast("string").alias("k"), F.xxhash64("id").alias("v"))
    other = rows.withColumn("v", F.when(F.col("k") == "123456", F.lit(0)).otherwise(F.col("v")))
    depth = merkle.depth_for(1_000_000)
    assert depth == 3
    trees = [merkle.tree(t, F.col("k"), merkle.row_digest(["v"]), depth) for t in (rows, other)]
    assert merkle.root(trees[0]) != merkle.root(trees[1])
    assert trees[0].where("level = 3").agg(F.max("n_rows"), F.count("*")).first()[0] < 10_000
    found, _, compared = merkle.differing_ranges(*trees)
    assert found == [hashlib.sha256(b"123456").hexdigest()[:3]] and compared == 1 + 3 * 16
    held = merkle.changes(rows, other, "k", ["v"], trees=tuple(trees)).collect()
    assert [(r["k"], r["change"]) for r in held] == [("123456", "changed")]


def test_trees_see_the_rows_alone(spark):
    rows = spark.createDataFrame([(str(i), i % 7) for i in range(500)] + [("1", 1), (None, None)], "k string, v int")
    build = lambda t, **o: merkle.root(merkle.tree(t, F.coalesce("k", F.lit("")), merkle.row_digest(["k", "v"]), **o))
    assert build(rows) == build(rows.repartition(7)) == build(rows.orderBy(F.desc("v")))
    assert build(rows, range_rows=10) == build(rows.repartition(3), range_rows=10) != build(rows.where("v <> 3"), range_rows=10)
    empty = rows.limit(0)
    assert build(empty) == hashlib.sha256(b"").hexdigest()
    assert merkle.changes(empty, empty, "k", ["v"]).count() == 0
    assert {r["change"] for r in merkle.changes(empty, rows.where("k = '7'"), "k", ["v"]).collect()} == {"added"}
    assert merkle.row_digest(["k", "v"]) is not None
    pairs = spark.createDataFrame([("a", "b,c"), ("a,1:b", "c"), (None, "-")], "x string, y string").select(merkle.row_digest(["x", "y"]).alias("d"))
    assert pairs.distinct().count() == 3


def test_ranges_on_disk_are_skipped(spark, tmp_path):
    rows = spark.range(40_000).select(F.col("id").cast("string").alias("k"), F.col("id").alias("v"))
    merkle.write_ranges(rows, F.col("k"), 2, str(tmp_path / "a"))
    merkle.write_ranges(rows.where("v <> 77"), F.col("k"), 2, str(tmp_path / "b"))
    a, b = (spark.read.parquet(str(tmp_path / n)) for n in "ab")
    trees = tuple(merkle.tree(t, F.col("k"), merkle.row_digest(["v"]), 2) for t in (a, b))
    found = merkle.changes(a, b, "k", ["v"], trees=trees)
    assert [(r["k"], r["change"]) for r in found.collect()] == [("77", "removed")]
    plan = found._sc._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    assert "PushedFilters: [EqualTo(range," in plan or "PushedFilters: [In(range" in plan or "EqualTo(range" in plan


def test_series_digests_of_any_length(spark):
    rows = [("long", i, f"p{i}") for i in range(2_500)] + [("short", 0, "x"), ("exact", 0, "a"), ("exact", 1, "b")]
    points = spark.createDataFrame(rows, "s string, at int, t string")
    want = {}
    for name in ("long", "short", "exact"):
        texts = [t for s, _, t in rows if s == name]
        level = [hashlib.sha256("\n".join(texts[i : i + 10]).encode()).hexdigest() for i in range(0, len(texts), 10)]
        while len(level) > 1:
            level = [level[i] if len(level[i : i + 6]) == 1 else hashlib.sha256("".join(level[i : i + 6]).encode()).hexdigest() for i in range(0, len(level), 6)]
        want[name] = (len(texts), level[0])
    for held in (points, points.repartition(9), points.where("s <> 'short'")):
        got = {r["s"]: (r["n_points"], r["digest"]) for r in series.series_tree_digests(held, ["s"], ["at"], F.col("t"), run=10, fan=6).collect()}
        assert got == {k: want[k] for k in got} and len(got) >= 2


# -- joins under skew ------------------------------------------------------------------------


@pytest.mark.parametrize("broadcast_rows", [1000, 0])
def test_keyed_join_takes_null_and_hot_keys(spark, broadcast_rows):
    rng = random.Random(1)
    keys = [rng.choice(["hot"] * 8 + [None, "a", "b", "lost"]) for _ in range(4000)]
    rows = spark.createDataFrame([(i, k, "x") for i, k in enumerate(keys)], "id int, k string, __salt string").drop("__salt").repartition(6)
    facts = spark.createDataFrame([("hot", 1), ("a", 2), (None, 3)], "k string, v int")
    got = {r["id"]: r["v"] for r in joins.keyed_join(rows, facts, ["k"], broadcast_rows).collect()}
    want = {i: {"hot": 1, "a": 2, None: 3}[k] for i, k in enumerate(keys) if k in ("hot", "a", None)}
    assert got == want


def test_a_compound_on_every_file_fills_no_task(spark):
    rows = [(f, 1, f"s{f}", "everywhere", "d", "c", float(f)) for f in range(3000)] + [(f, 2, f"s{f}", f"own{f}", "d", "c", 1.0) for f in range(3000)]
    peaks = spark.createDataFrame(rows, "file_id long, row_no int, sample_id string, compound string, detector string, channel string, area double")
    small = P.compound_matrix_long(peaks, ["file_id", "row_no"])
    large = P.compound_matrix_long(peaks, ["file_id", "row_no"], broadcast_rows=10)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect())) and large.count() == 6000
    # Its rows meet the identity in as many tasks as there are salts (small ones aren't put together again here).
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    large = P.compound_matrix_long(peaks, ["file_id", "row_no"], broadcast_rows=10)
    spread_over = large.where(F.col("column_name").contains("everywhere")).select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert max(r["count"] for r in spread_over) < 1000


# -- canonical JSON --------------------------------------------------------------------------


def test_canonical_json_is_pythons(spark):
    texts = ["", "plain", 'quote " and \\', "tab\tline\nfeed\r\b\f", "é中\U0001f9ea \x7f\x00\x1f", None]
    rows = [(i, t, [t, "x"], {"b": 1, "a é": 2}, i % 2 == 0, (t, i)) for i, t in enumerate(texts)]
    schema = "i long, t string, l array<string>, m map<string,int>, b boolean, s struct<z:string,a:long>"
    df = spark.createDataFrame(rows, schema)
    whole = df.withColumn("v", F.struct(*df.columns))
    got = [r["j"] for r in whole.orderBy("i").select(canonical.canonical_json(F.col("v"), whole.schema["v"].dataType).alias("j")).collect()]
    want = [json.dumps({"i": i, "t": t, "l": v, "m": m, "b": b, "s": {"z": s[0], "a": s[1]}}, sort_keys=True, ensure_ascii=True, separators=(",", ":")) for i, t, v, m, b, s in rows]
    assert got == want
    with pytest.raises(TypeError):
        canonical.canonical_json(F.col("x"), spark.range(1).select(F.lit(0.5)).schema[0].dataType)
    tagged = whole.orderBy("i").select(canonical.digest(F.col("v"), whole.schema["v"].dataType, "tag").alias("d")).first()["d"]
    assert tagged == mapping.fingerprint(json.loads(want[0]), "tag")


def test_fingerprints_by_kind(spark):
    schema = "profile_id string, source_format string, worksheet_title string, retention_time_unit string, area_unit string, height_unit string, secondary_retention_time_unit string, display_label string"
    base = ("csv", None, "min", "mV", None, None, "label")
    rows = [("a", *base), ("relabelled", *base[:-1], "other"), ("unit", "csv", None, "min", "pA", None, None, "label"), ("titled", "xlsx", "Sheet", "min", "mV", None, None, "l"), ("retitled", "xlsx", "Other", "min", "mV", None, None, "l")]
    roles = [(1, "RT", "retention_time"), (2, "Area", "area"), (3, "Note", "IGNORED")]
    columns = [(p, *c) for p, *_ in rows for c in roles] + [("renamed", *c) for c in [(1, "Zeit", "retention_time"), (2, "Area", "area"), (3, "Note", "IGNORED")]]
    held = spark.createDataFrame([*rows, ("renamed", *base)], schema)
    table = spark.createDataFrame(columns, "profile_id string, position int, label string, role string")
    prints = fingerprints.profile_fingerprints(held, table.orderBy(F.desc("position")))
    got = {r["profile_id"]: r for r in prints.collect()}
    kinds = ("exact_structure", "public_structure", "semantic")
    same = lambda x, y: tuple(got[x][k] == got[y][k] for k in kinds)
    assert same("a", "relabelled") == (True, True, True)  # a display label is no behaviour
    assert same("a", "unit") == (True, True, False)
    assert same("a", "renamed") == (False, True, False)  # labels are local
    assert same("titled", "retitled") == (False, True, False)
    assert not any(same("a", "titled"))
    want = {"source_format": "csv", "headers": ["RT", "Area", "Note"], "worksheet_title": None}
    assert got["a"]["exact_structure"] == hashlib.sha256(json.dumps(want, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert [r["profile_ids"] for r in fingerprints.repeated_profiles(prints).collect()] == [["a", "relabelled"]]
    members = spark.createDataFrame([("s", 1, "a"), ("s", 2, "titled"), ("t", 2, "a"), ("t", 1, "titled"), ("u", 5, "relabelled"), ("u", 9, "retitled")], "set_id string, position int, profile_id string")
    sets = {r["set_id"]: (r["n_profiles"], r["fingerprint"]) for r in fingerprints.set_fingerprint(members, prints).collect()}
    assert sets["s"][0] == 2 and sets["s"] != sets["t"] and sets["s"] == sets["u"]


# -- sheets ----------------------------------------------------------------------------------


def test_sheet_election(spark):
    good, bad, other = ["RT", "Area", None, " "], ["RT", "RT"], ["x"]
    rows = [
        (1, 1, "A", True, good), (1, 2, "B", True, other), (2, 1, "A", True, good), (2, 2, "B", True, good), (3, 1, "A", False, good), (3, 2, "B", True, other),
        (4, 1, "A", True, bad), (5, 1, "A", True, bad), (5, 2, "B", True, bad), (6, 1, "A", None, []),
    ]
    table = spark.createDataFrame(rows, "file_id long, sheet_no int, title string, visible boolean, headers array<string>")
    names = sheets.trimmed_headers(F.col("headers"))
    judged = sheets.judged_sheets(table, F.array_contains(names, "Area"), F.when(F.size(F.array_distinct(names)) < F.size(names), "DUPLICATE_HEADER"))
    told = lambda **o: {r["file_id"]: (r["sheet_no"], r["code"]) for r in sheets.elect_sheets(judged, **o).collect()}
    assert told() == {1: (1, None), 2: (None, sheets.SEVERAL), 3: (None, sheets.NONE), 4: (None, "DUPLICATE_HEADER"), 5: (None, sheets.SEVERAL), 6: (None, sheets.NONE)}
    assert told(include_hidden=True)[3] == (1, None)
    assert told(named="A") == {1: (1, None), 2: (1, None), 3: (1, None), 4: (None, "DUPLICATE_HEADER"), 5: (None, "DUPLICATE_HEADER"), 6: (None, sheets.UNRECOGNIZED)}
    assert told(named="B")[4] == (None, sheets.NOT_FOUND)
    chosen = sheets.sheet_structures(judged, sheets.elect_sheets(judged)).collect()
    assert [(r["file_id"], r["headers"], r["worksheet_title"]) for r in chosen] == [(1, ["RT", "Area"], "A")]


# -- wide integers ---------------------------------------------------------------------------


def test_whole_integers_sort_as_numbers(spark):
    rng = random.Random(4)
    numbers = [rng.choice([-1, 1]) * rng.randrange(10 ** rng.randrange(1, 1000)) for _ in range(300)] + [0, 7, -7, 10**999, -(10**999), 10**38, 10**38 - 1]
    rows = [(i, str(n)) for i, n in enumerate(numbers)]
    read = spark.createDataFrame(rows, "i int, t string").select("i", L.whole_integer(F.col("t")).alias("r")).select("i", "r.*")
    assert [r["i"] for r in read.orderBy("key", "i").collect()] == sorted(range(len(numbers)), key=lambda i: (numbers[i], i))
    got = {r["i"]: (r["whole"], r["value"], r["code"]) for r in read.collect()}
    for i, n in enumerate(numbers):
        assert got[i] == (str(n), n if abs(n) < 10**38 else None, None)
    odd = spark.createDataFrame([("1e999",), ("1e1000",), ("-0.0",), ("2.50e1",), ("2.55e1",), ("",), ("nan",), ("x",), (None,)], "t string")
    told = [(r["w"], r["c"]) for r in odd.select(L.whole_integer(F.col("t"))["whole"].alias("w"), L.whole_integer(F.col("t"))["code"].alias("c")).collect()]
    assert told == [("1" + "0" * 999, None), (None, "INTEGER_LIMIT_EXCEEDED"), ("0", None), ("25", None), (None, "INVALID_INTEGER"), (None, None), (None, "NONFINITE_NUMBER"), (None, "INVALID_NUMBER"), (None, None)]
