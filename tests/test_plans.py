"""Recipes, plans, profiles in conversions, publishing, manifests, streams."""

from __future__ import annotations

import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tallyloom.plans import convert, publish
from tallyloom.plans.planning import plan_changes, summarise_plan
from tallyloom.plans.recipes import Profile, Recipe, RecipeFault

PROFILE = Profile("p1", "csv", (("Zeit", "retention_time"), ("Fläche", "area"), ("Stoff", "compound"), ("Notiz", "IGNORED")), "min", "mV.s", display_label="my label")
RECIPE = Recipe(recursive=True, extensions=(".csv", ".tsv"), sort="filename", include_signals=True, on_error="stop", sidecar_mode="csv", profiles=(PROFILE,), display_label="주간")


def put(folder, name: str, text: str) -> None:
    (folder / name).parent.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(text, encoding="utf-8")


# -- recipes ---------------------------------------------------------------------------------


def test_recipes_round_trip_and_hold_no_paths():
    back = Recipe.from_json(RECIPE.to_json())
    assert back == RECIPE and back.to_json() == RECIPE.to_json() and back.display_label == "주간"
    assert not any(word in RECIPE.to_json() for word in ("/Users/", "C:\\", "path", "overwrite"))
    loose = json.dumps(json.loads(RECIPE.to_json()), ensure_ascii=False, separators=(",", ":"), sort_keys=False)
    assert Recipe.from_json(loose).fingerprint() == Recipe.from_json(RECIPE.to_json().replace("\n", "\r\n")).fingerprint() == RECIPE.fingerprint()


def test_labels_are_no_behaviour():
    other = replace(RECIPE, display_label=None, profiles=(replace(PROFILE, display_label="other"),))
    assert other.fingerprint() == RECIPE.fingerprint() and other.public_fingerprint() == RECIPE.public_fingerprint()
    renamed = replace(RECIPE, profiles=(replace(PROFILE, columns=(("t", "retention_time"), *PROFILE.columns[1:])),))
    assert renamed.fingerprint() != RECIPE.fingerprint() and renamed.public_fingerprint() == RECIPE.public_fingerprint()
    assert Recipe(sheet="A").fingerprint() != Recipe(sheet="B").fingerprint() and Recipe(sheet="A").public_fingerprint() == Recipe(sheet="B").public_fingerprint()


@pytest.mark.parametrize("change", [{"recursive": True}, {"extensions": (".csv",)}, {"sort": "input_order"}, {"include_signals": True}, {"adapter": "delimited"}, {"sheet": "R"}, {"include_hidden_sheets": True}, {"on_error": "stop"}, {"sidecar_mode": "csv"}])
def test_every_option_is_behaviour(change):
    assert Recipe(**change).fingerprint() != Recipe().fingerprint() and Recipe(**change).public_fingerprint() != Recipe().public_fingerprint()


@pytest.mark.parametrize("change", [
    lambda r: r.update(unknown=True), lambda r: r.pop("options"), lambda r: r["options"].update(recursive=1), lambda r: r["options"].update(sort="sideways"), lambda r: r["options"].update(extra=None),
    lambda r: r["profiles"].append({}), lambda r: r.update(version=2), lambda r: r.update(version=True), lambda r: r["profiles"][0].update(source_format="doc"), lambda r: r["profiles"][0]["columns"].append(["x", "area"]),
    lambda r: r["profiles"].append(r["profiles"][0]), lambda r: r["profiles"].append(r["profiles"][0] | {"profile_id": "p2"}), lambda r: r["options"].update(adapter="x"), lambda r: r["options"].update(extensions=[1]),
])
def test_recipes_of_another_schema_are_refused(change):
    whole = json.loads(RECIPE.to_json())
    change(whole)
    with pytest.raises(RecipeFault) as told:
        Recipe.from_json(json.dumps(whole))
    assert told.value.code == "CONVERSION_RECIPE_INVALID"


@pytest.mark.parametrize("text", ['{"version":1,"version":1}', '{"version":NaN}', "\ud800", "{", "[" * 100_000, "[]"])
def test_texts_that_are_no_recipe(text):
    with pytest.raises(RecipeFault):
        Recipe.from_json(text)


# -- plans and conversions with profiles -----------------------------------------------------


@pytest.fixture(scope="module")
def mixed(tmp_path_factory):
    d = tmp_path_factory.mktemp("mixed")
    put(d, "a.csv", "Zeit,Fläche,Stoff,Notiz\n1.5,10,ethanol,n\n2.5,20,,\n\n")
    put(d, "b.csv", "Zeit,Fläche,Stoff,Notiz,neu\n1,2,x,,\n")
    put(d, "c.csv", "a,b\n1,2\n")
    put(d, "d.csv", "Zeit,Fläche,Stoff,Notiz\n1.5,zehn,x,\n")
    put(d, "e.csv", "rt,area\n1,2\n")
    put(d, "f.tsv", "Zeit\tFläche\tStoff\tNotiz\n1\t2\tx\t\n")
    put(d, "g.txt", "[Header]\r\nApplication Name\tX\r\n\r\n[Peak Table(Ch1)]\r\n# of Peaks\t1\r\nPeak#\tR.Time\tI.Time\tF.Time\tArea\tHeight\tName\r\n1\t1.5\t1.0\t2.0\t10\t3\tethanol\r\n")
    return d


def test_a_profile_reads_its_tables_and_nothing_else(spark, mixed, tmp_path):
    recipe = Recipe(sort="filename", profiles=(PROFILE,))
    out = convert.convert(spark, [str(mixed)], recipe)
    log = {r["relative_path"]: (r["status"], r["error_code"]) for r in out.import_log.collect()}
    refused = ("failed", "PEAK_MAPPING_PROFILE_NOT_MATCHED")
    assert log == {"a.csv": ("success", ""), "b.csv": refused, "c.csv": refused, "d.csv": ("failed", "PEAK_MAPPING_NUMBER_INVALID"), "e.csv": refused, "f.tsv": refused, "g.txt": ("success", "")}
    peaks = sorted((r["source_file"], r["sample_id"], r["retention_time"], r["area"], r["compound"], r["retention_time_unit"], r["area_unit"], r["observation_order"]) for r in out.peaks.where("source_file = 'a.csv'").collect())
    assert peaks == [("a.csv", "a", 1.5, 10.0, "ethanol", "min", "mV.s", 1), ("a.csv", "a", 2.5, 20.0, None, "min", "mV.s", 2)]
    names = {r["file_id"]: r["relative_path"] for r in out.files.collect()}
    routes = {names[r["file_id"]]: (r["mapping_route"], r["mapping_profile_id"]) for r in out.routes.collect()}
    assert routes["a.csv"] == ("USER_MAPPING", "p1") and routes["b.csv"] == ("SCHEMA_DRIFT_CANDIDATE", None) and routes["g.txt"] == ("EXACT_ADAPTER", None) and routes["f.tsv"] == ("NO_MAPPING_MATCH", None)
    told = out.route_counts.first()
    assert (told["exact_adapter_routes"], told["drift_candidates"]) == (1, 1)
    assert {names[r["file_id"]] for r in out.drift.where("array_contains(categories, 'column_added')").collect()} == {"b.csv"}
    counts = out.results.first()
    assert (counts["total_sources"], counts["converted_sources"], counts["failed_sources"], counts["peak_records"], counts["sample_records"]) == (7, 2, 5, 3, 2)
    facts = {(r["key"], r["value"]) for r in out.metadata.collect()}
    assert {("mapping_profile_id", "p1"), ("ignored_columns", "1"), ("mapped_rows", "2")} <= facts


def test_two_profiles_and_none(spark, mixed):
    second = Profile("p2", "csv", (("rt", "retention_time"), ("area", "area")), "s")
    out = convert.convert(spark, [str(mixed)], Recipe(sort="filename", extensions=("csv",), profiles=(PROFILE, second)))
    assert {r["source_file"] for r in out.peaks.collect()} == {"a.csv", "e.csv"}
    told = out.route_counts.first()
    assert told["mapping_profiles_used"] == 2
    plain = convert.convert(spark, [str(mixed)], Recipe(sort="filename", extensions=("csv",)))
    assert {r["source_file"] for r in plain.peaks.collect()} == {"e.csv"} and plain.drift is None


def test_plans_route_without_reading_and_notice_changes(spark, tmp_path):
    put(tmp_path, "a.csv", "Zeit,Fläche,Stoff,Notiz\n1.5,bad value far below\n")
    put(tmp_path, "b.csv", "rt,area\n1,2\n")
    put(tmp_path, "c.bin", "what,is\n1,2\n")
    put(tmp_path, "results_peaks_001.csv", "rt,area\n1,2\n")
    paths, recipe = [str(tmp_path)], Recipe(sort="filename", profiles=(PROFILE,))
    entries = convert.plan(spark, paths, recipe)
    got = {r["relative_path"]: (r["status"], r["route"], r["problem"]) for r in entries.collect()}
    assert got == {"a.csv": ("ROUTABLE", "USER_MAPPING", None), "b.csv": ("FAILED", None, "UNMAPPED_GENERIC_TABLE"), "c.bin": ("FAILED", None, "UNSUPPORTED_FORMAT"), "results_peaks_001.csv": ("EXCLUDED_ARTIFACT", None, None)}
    assert summarise_plan(entries).first()["readiness"] == "READY_WITH_KNOWN_FAILURES"
    plain = {r["relative_path"]: (r["status"], r["route"], r["problem"]) for r in convert.plan(spark, paths).collect()}
    assert plain["b.csv"] == ("ROUTABLE", "GENERIC_INPUT", None) and plain["a.csv"] == ("FAILED", None, "UNSUPPORTED_FORMAT")
    for limits, code in (((3, 1 << 30), "PLAN_FILE_LIMIT_EXCEEDED"), ((10, 20), "PLAN_SIZE_LIMIT_EXCEEDED")):
        with pytest.raises(convert.PlanRefused, match=code):
            convert.plan(spark, paths, limits=limits)
        with pytest.raises(convert.PlanRefused, match=code):
            convert.convert(spark, paths, limits=limits)
    assert convert.convert(spark, paths, recipe, reviewed=entries).files.count() == 4
    put(tmp_path, "b.csv", "rt,area\n1,3\n")
    assert [(r["change"], r["b"]["relative_path"]) for r in plan_changes(entries, convert.plan(spark, paths, recipe)).collect()] == [("changed", "b.csv")]
    with pytest.raises(convert.PlanRefused, match="CONVERSION_PLAN_STALE: changed"):
        convert.convert(spark, paths, recipe, reviewed=entries)


# -- publishing ------------------------------------------------------------------------------


def test_publishing_keeps_inputs_and_outputs_apart(spark, tmp_path):
    put(tmp_path / "in", "a.csv", "rt,area,compound\n1,2,=x\n3,4,y\n")
    out = convert.convert(spark, [str(tmp_path / "in")])
    for folder in (tmp_path / "in", tmp_path / "in" / "a.csv", tmp_path):
        with pytest.raises(publish.PublishRefused, match="OUTPUT_IS_INPUT"):
            convert.publish(out, str(folder))
    facts = {r["table"]: r for r in convert.publish(out, str(tmp_path / "out")).collect()}
    assert facts["peaks"]["row_count"] == 2 and facts["peaks"]["formula_like"] == 1 and not facts["peaks"]["sidecar"]
    with pytest.raises(publish.PublishRefused, match="OUTPUT_EXISTS"):
        convert.publish(out, str(tmp_path / "out"))
    convert.publish(out, str(tmp_path / "out"), overwrite=True)
    rows = {r["key"]: r["value"] for r in spark.read.parquet(str(tmp_path / "out" / "manifest")).collect()}
    assert len(rows) == 44 and rows["success_count"] == "1" and rows["peak_record_count"] == "2" and rows["option_overwrite"] == "True" and rows["formula_like_literal_count"] == "2"
    assert str(tmp_path) not in " ".join(rows.values())


def test_texts_beyond_a_cell_go_to_a_part(spark, tmp_path):
    long = "x" * 32_768
    peaks = spark.createDataFrame([("s", "=a"), ("t", long)], "sample_id string, compound string")
    matrix = spark.createDataFrame([("s", "f", long)], "sample_id string, source_file string, column_name string")
    log = spark.createDataFrame([("ok",)], "message string")
    with pytest.raises(publish.PublishRefused, match="EXCEL_CELL_TEXT_LIMIT: peaks, matrix"):
        publish.write_tables({"peaks": peaks, "matrix": matrix, "import_log": log}, str(tmp_path / "a"))
    assert not (tmp_path / "a" / "peaks").exists()
    facts, parts = publish.write_tables({"peaks": peaks, "matrix": matrix, "import_log": log}, str(tmp_path / "b"), "csv")
    assert {r["table"]: (r["row_count"], r["longest"], r["sidecar"]) for r in facts.collect()} == {"peaks": (2, 32_768, True), "matrix": (1, 32_768, True), "import_log": (1, 2, False)}
    assert {r["relative_path"]: (r["row_count"], r["formula_escape_count"]) for r in parts.collect()} == {"peaks_001.csv": (2, 1), "matrix_001.csv": (1, 0)}
    assert spark.read.parquet(str(tmp_path / "b" / "peaks")).columns == ["sample_id", "compound"] and spark.read.parquet(str(tmp_path / "b" / "peaks")).count() == 0
    assert spark.read.parquet(str(tmp_path / "b" / "matrix")).columns == ["sample_id", "sidecar_status"]
    with pytest.raises(publish.PublishRefused, match="import_log"):
        publish.write_tables({"import_log": log.withColumn("message", F.lit(long))}, str(tmp_path / "c"), "csv")
    with pytest.raises(publish.PublishRefused, match="SIDECAR_MODE_INVALID"):
        publish.write_tables({"import_log": log}, str(tmp_path / "d"), "tsv")


# -- streams ---------------------------------------------------------------------------------


def test_repeats_are_dropped_within_the_watermark_and_forgotten_after(spark, tmp_path):
    from tallyloom.streaming import ingest

    notices = tmp_path / "notices"
    notices.mkdir()

    def tell(number: int, *rows) -> None:
        text = "".join(json.dumps({"path": p, "modificationTime": t}) + "\n" for p, t in rows)
        (notices / f"{number}.json").write_text(text, encoding="utf-8")

    def run() -> list:
        seen: list = []
        stream = spark.readStream.schema("path string, modificationTime timestamp").json(str(notices))
        ingest.consolidate(stream, lambda paths, n: seen.append(paths), str(tmp_path / "checkpoint"), "1 hour", most_files=2).awaitTermination(120)
        return seen

    tell(1, ("a", "2026-01-01T00:00:00Z"), ("b", "2026-01-01T00:00:00Z"), ("a", "2026-01-01T00:10:00Z"), ("c", "2026-01-01T00:20:00Z"))
    assert run() == [["a", "b"], ["c"]]
    tell(2, ("a", "2026-01-01T00:30:00Z"), ("d", "2026-01-01T00:40:00Z"))
    assert run() == [["d"]]  # from the checkpoint, with its state
    tell(3, ("e", "2026-01-01T09:00:00Z"))
    assert run() == [["e"]]
    tell(4, ("a", "2026-01-01T09:10:00Z"), ("e", "2026-01-01T09:10:00Z"))
    assert run() == [["a"]]  # its state has gone; that of e hasn't
    assert run() == []


def test_batches_of_files_are_bounded(spark, tmp_path):
    from tallyloom.streaming import ingest

    for i in range(5):
        put(tmp_path / "in", f"{i}.csv", "rt,area\n1,2\n")
    seen: list = []
    stream = ingest.stream_sources(spark, str(tmp_path / "in"), "*.csv", most_files=2)
    ingest.consolidate(stream, lambda paths, n: seen.append((n, len(paths))), str(tmp_path / "checkpoint")).awaitTermination(120)
    assert sum(n for _, n in seen) == 5 and max(n for _, n in seen) <= 2 and len({b for b, _ in seen}) >= 3
