"""Folders of result files, vendor texts and whole conversions."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from tallyloom.plans import convert, planning
from tallyloom.sources import formats, results, scan
from tallyloom.streaming import ingest

HEAD = "sample_id,acquired_at,peak_number,RT,area,height,compound,batch_note"


def write(folder, name, text, encoding="utf-8"):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(text if isinstance(text, bytes) else text.encode(encoding))
    return path


@pytest.fixture
def folder(tmp_path):
    d = str(tmp_path / "in")
    write(d, "run_10.csv", f"{HEAD}\nr10,2026-01-01T03:00:00Z,1,1.25,100.5,8,methanol,n\nr10,,2,2.5,200,9,methanol,\n")
    write(d, "run_2.tsv", "area\trt\tcompound\n7.5\t1.0\tethanol\n,,\n\t\t\n".replace(",,\n", ""))
    write(d, "run_1.txt", "rt;area;compound;acquired_at\n1;2;\"semi;colon\";2026-01-01T01:00:00Z\n")
    write(d, "broken.csv", "a,b\n\"open")
    write(d, "zero.csv", b"a\0b")
    write(d, "latin.csv", "rt,area\n1,é\n".encode("latin-1"))
    write(d, "twice.csv", "rt,RT,area\n1,2,3\n")
    write(d, "odd.csv", "foo,bar\n1,2\n")
    write(d, "rough.csv", f"{HEAD}\n x ,2026-01-01T02:00:00,1.5,NaN,0.1000000000000000055,1e400,  ,k,extra\ny,,3, 4 ,5,6,z,\n")
    write(d, "sub/deep.csv", "rt,area\n1,2\n")
    return d


def test_discovery(spark, folder):
    found = scan.discover(spark, [folder], extensions=["CSV", ".tsv"]).orderBy("input_order").collect()
    assert [r["name"] for r in found] == ["broken.csv", "latin.csv", "odd.csv", "rough.csv", "run_2.tsv", "run_10.csv", "twice.csv", "zero.csv"]
    assert scan.discover(spark, [folder], recursive=True).count() == 10
    again = scan.mark_duplicates(scan.discover(spark, [folder, folder], extensions=["tsv"]), "path").orderBy("input_order").collect()
    assert [r["duplicate_of"] for r in again] == [None, 0]
    hashed = scan.with_hash(scan.discover(spark, [folder])).where("name = 'odd.csv'").first()
    import hashlib

    assert hashed["sha256"] == hashlib.sha256(b"foo,bar\n1,2\n").hexdigest()


def test_path_names(spark):
    rows = spark.createDataFrame([(0, "A.csv"), (1, "a.csv"), (2, "input_001/A.csv"), (3, "b.csv")], "input_order long, relative_path string")
    got = [r["relative_path"] for r in scan.distinct_paths(rows).orderBy("input_order").collect()]
    assert got == ["input_001/A.csv", "input_002/a.csv", "record_000003_001/input_001/A.csv", "b.csv"]
    names = spark.createDataFrame([("out.xlsx",), ("out_peaks_001.csv",), ("other.csv",)], "name string")
    assert [r["excluded"] for r in scan.own_outputs(names, "out").collect()] == [True, True, False]


def test_sizes(spark):
    rows = spark.createDataFrame([(1, 1), (2, 256 << 20), (3, (2 << 30) + 1)], "file_id long, size long")
    assert [(r["file_id"], r["severity"]) for r in scan.size_issues(rows).orderBy("file_id").collect()] == [(2, "warning"), (3, "error")]


def test_convert(spark, folder, tmp_path):
    out = convert.convert(spark, [folder], planning.Recipe(sort="filename"))
    log = {r["relative_path"]: r for r in out.import_log.collect()}
    status = {k: v["status"] for k, v in log.items()}
    assert status == {"run_10.csv": "success", "run_2.tsv": "success", "run_1.txt": "success", "broken.csv": "failed", "zero.csv": "failed", "latin.csv": "failed", "twice.csv": "failed", "odd.csv": "failed", "rough.csv": "warning"}
    assert [log[k]["error_code"] for k in ("broken.csv", "zero.csv", "latin.csv", "odd.csv")] == ["DELIMITED_SYNTAX_INVALID", "NUL_BYTE", "INVALID_UTF8", "FORMAT_NOT_DETECTED"]
    ordered = [r["relative_path"] for r in out.files.where("ok").orderBy("file_rank").collect()]
    assert ordered == ["rough.csv", "run_1.txt", "run_2.tsv", "run_10.csv"]
    peaks = {(r["source_file"], r["row_no"]): r for r in out.peaks.collect()}
    assert peaks["run_10.csv", 2]["sample_id"] == "r10" and peaks["run_10.csv", 1]["area"] == 100.5 and peaks["run_2.tsv", 1]["sample_id"] == "run_2"
    assert peaks["run_1.txt", 1]["compound"] == "semi;colon" and ("run_2.tsv", 2) not in peaks
    codes = {r["code"] for r in out.issues.join(out.files, "file_id").where("relative_path = 'rough.csv'").collect()}
    assert {"NONFINITE_NUMBER", "LOSSY_FLOAT_REJECTED", "INVALID_INTEGER", "MAPPED_TEXT_WHITESPACE_ONLY", "PARSE_LEXEME_WHITESPACE_TRIMMED", "TIMESTAMP_TIMEZONE_MISSING", "MULTIPLE_SAMPLE_IDS", "UNMAPPED_EXTRA_CELLS"} <= codes
    names = {(r["column_name"], r["area"]) for r in out.matrix.collect()}
    assert ("methanol_area", 100.5) in names and ("methanol_area_2", 200.0) in names
    facts = {(r["key"], r["value"]) for r in out.metadata.collect()}
    assert {("batch_note", "n"), ("area", "0.1000000000000000055"), ("unmapped_column_9", "extra")} <= facts
    assert out.summary.first()["outcome"] == "partial_success"
    written = {r["table"]: r["row_count"] for r in convert.publish(out, f"{tmp_path}/out").collect()}
    assert written["import_log"] == 9
    with pytest.raises(Exception, match="exist"):
        convert.publish(out, f"{tmp_path}/out")


def test_convert_reads_all_formats(spark, tmp_path):
    import pandas as pd

    d = str(tmp_path / "mixed")
    write(d, "a.csv", "rt,area\n1,2\n")
    write(d, "b.txt", "[Header]\r\nApplication Name\tX\r\n\r\n[Peak Table(Ch1)]\r\n# of Peaks\t1\r\nPeak#\tR.Time\tI.Time\tF.Time\tArea\tHeight\tName\r\n1\t1.5\t1.0\t2.0\t10\t3\tethanol\r\n")
    write(d, "c.csv", "Signal No.\tSignal Name\tPeak No.\tReten. time [min]\tArea\tHeight\tArea %\tHeight %\tW05\r\n1\t\uac00\t1\t1.25\t5\t2\t1\t1\t1\r\nTotal\t\t\t\t5\t2\t\t\t\r\n\r\n", "cp949")
    write(d, "d.txt", "Name\t1st Dimension Time (s)\t2nd Dimension Time (s)\tArea\tHeight\tSpectra\twb1\twb2\tRetention Index\r\nunknown\t10\t1.5\t7\t3\t1:2\t1\t1\t1\r\nbad\r\n")
    write(d, "e.own", "OWN 4 9")
    write(d, "f.own", "OWN x")
    write(d, "g.txt", "[Header]\n[Peak Table(Ch1)]\n")
    kinds = formats.Formats()

    def parse(raw: bytes) -> pd.DataFrame:
        parts = raw.decode().split()
        if len(parts) != 3:
            raise formats.FormatFault("OWN_SHAPE")
        return pd.DataFrame({"retention_time": [float(parts[1])], "area": [float(parts[2])]})

    kinds.register("own", F.col("extension") == ".own", F.lit(0.9), parse, "retention_time double, area double")
    out = convert.convert(spark, [d], planning.Recipe(sort="filename"), kinds)
    files = {r["relative_path"]: (r["adapter"], r["status"]) for r in out.files.collect()}
    assert files == {"a.csv": ("delimited", "success"), "b.txt": ("sectioned_text", "success"), "c.csv": ("signal_sections", "success"), "d.txt": ("two_dimensional_text", "failed"), "e.own": ("own", "success"), "f.own": ("own", "failed"), "g.txt": ("sectioned_text", "warning")}
    peaks = {(r["source_file"], r["sample_id"], r["channel"], r["retention_time"], r["area"], r["compound"]) for r in out.peaks.collect()}
    assert peaks == {("a.csv", "a", None, 1.0, 2.0, None), ("b.txt", "b", "Ch1", 1.5, 10.0, "ethanol"), ("c.csv", "c", "\uac00", 1.25, 5.0, None), ("e.own", "e", None, 4.0, 9.0, None)}
    assert {r["file_id"] for r in out.samples.collect()} == {r["file_id"] for r in out.files.where("ok").collect()}
    seen, issues = convert.inspect(spark, [d], planning.Recipe(adapter="delimited"))
    assert {r["adapter"] for r in seen.collect()} == {"delimited"} and issues.where("severity = 'error'").count() > 0


def test_preview_and_header_search(spark, folder):
    cells = scan.read_cells(spark, scan.discover(spark, [folder], extensions=["csv"]), [folder]).where("error is null")
    shown = scan.preview(cells, 1).where("row_no = 0").collect()
    assert ["foo", "bar"] in [r["cells"] for r in shown]
    lines = spark.createDataFrame([(1, 0, "title"), (1, 1, "No.\tR.Time [min]\tArea (mV)"), (1, 2, "rt,area"), (2, 0, "nothing")], "file_id long, line_no int, line string")
    assert [(r["file_id"], r["line_no"]) for r in scan.find_header_row(lines).collect()] == [(1, 1)]


def lines_of(spark, texts):
    return results.text_lines(spark.createDataFrame([(i, t.encode()) for i, t in texts.items()], "file_id long, content binary"))


def test_sectioned_result(spark):
    text = "[Header]\r\nApplication Name\tX\r\n\r\n[Peak Table(Ch1)]\r\n# of Peaks\t2\r\nPeak#\tR.Time\tI.Time\tF.Time\tArea\tHeight\tName\r\n1\t1.5\t1.0\t2.0\t10\t3\tunknown\r\n2\t2.5\t2.1\t3.0\t20\t4\tethanol\r\n\r\n[Chromatogram (Ch1)]\r\nInterval(msec)\t20\r\nR.Time (min)\tIntensity\r\n0.0\t5\r\n0.1\t6\r\n"
    peaks, points, facts = results.sectioned_result(lines_of(spark, {1: text}))
    assert [(r["peak_number"], r["retention_time"], r["area"], r["compound"]) for r in peaks.orderBy("peak_number").collect()] == [(1, 1.5, 10.0, None), (2, 2.5, 20.0, "ethanol")]
    assert [(r["point_no"], r["x"], r["y"]) for r in points.orderBy("point_no").collect()] == [(0, 0.0, 5.0), (1, 0.1, 6.0)]
    assert ("# of Peaks", "2") in {(r["key"], r["value"]) for r in facts.collect()}


def test_signal_sections(spark):
    head = "Signal No.\tSignal Name\tPeak No.\tReten. time [min]\tArea [mV.s]\tHeight [mV]\tArea [%]\tHeight [%]\tW05 [min]"
    text = "\r\n".join([head, "1\tFID\t1\t1.0\t10.5\t2\t50\t50\t0.1", "1\tFID\t2\t2.0\t10.5\t3\t50\t50\t0.1", "\t\tTotal\t\t21.0\t5\t100\t100\t", "", "trailer", head, "2\tTCD\t1\t3.0\t1\t1\t1\t1\t1", "\t\tTotal\t\t1\t1\t\t\t", ""])
    peaks, totals = results.signal_sections(lines_of(spark, {1: text}))
    assert [(r["section"], r["signal_name"], r["area"], r["observation_order"]) for r in peaks.orderBy("section", "observation_order").collect()] == [(1, "FID", 10.5, 1), (1, "FID", 10.5, 2), (2, "TCD", 1.0, 1)]
    assert [(r["section"], r["area_total"]) for r in totals.orderBy("section").collect()] == [(1, "21.0"), (2, "1")]
    korean = spark.createDataFrame([("시료".encode("cp949"),), (b"\xff\xff",)], "b binary").select(results.korean_text(F.col("b")).alias("t"))
    assert [r["t"] for r in korean.collect()] == ["시료", None]


def test_two_dimensional(spark):
    text = "Name\tRT1\tRT2\tArea\tHeight\tSpectra\twb1\twb2\tIndex\r\nUnknown\t10\t1.5\t100\t9\t41:5 43:10\t1\t2\t800\r\nethanol\t20\t2\t50\t8\tx\t1\t2\t\r\nshort\trow\r\n"
    peaks, faults = results.two_dimensional_result(lines_of(spark, {1: text}))
    got = peaks.select("*", results.spectrum_pairs(F.col("spectrum")).alias("s")).orderBy("observation_order").collect()
    assert [(r["compound"], r["secondary_retention_time"]) for r in got] == [(None, 1.5), ("ethanol", 2.0)] and got[1]["s"] is None
    assert [tuple(x) for x in got[0]["s"]] == [(41.0, 5.0), (43.0, 10.0)]
    assert [r["line_no"] for r in faults.collect()] == [3]
    side = {(r["key"], r["value"]) for r in results.side_metadata(peaks, ["wb1", "index"]).collect()}
    assert ("peak_000001_index", "800") in side


def test_xml_result(spark):
    def document(area):
        peak = f'<Peak><MeasRetTime Unit="min">1.5</MeasRetTime><Area Unit="pA*s">10.5</Area><Height Unit="pA">3</Height><Name>ethanol</Name></Peak>'
        rows = f"<IntegrationResults><RetTime>1.5</RetTime><Area>{area}</Area><Height>3</Height><TimeStart>1</TimeStart><TimeEnd>2</TimeEnd></IntegrationResults>"
        return f'<?xml version="1.0" encoding="utf-16"?><R><Chromatograms><Signal><Detector>FID1</Detector><SignalId>A</SignalId>{rows}{rows}</Signal></Chromatograms><Results><ResultsGroup>{peak}{peak}</ResultsGroup></Results></R>'.encode("utf-16")

    files = spark.createDataFrame([(1, document("10.5")), (2, document("9"))], "file_id long, content binary")
    peaks, faults = results.xml_result(files)
    got = peaks.collect()
    assert {(r["file_id"], r["area"], r["area_unit"], r["start_time"], r["compound"]) for r in got} == {(1, 10.5, "pA*s", 1.0, "ethanol")} and len(got) == 2
    assert [(r["file_id"], r["pos"]) for r in faults.orderBy("pos").collect()] == [(2, 0), (2, 1)]


def test_user_formats(spark):
    import pandas as pd

    def parse(content):
        if content == b"bad":
            raise formats.FormatFault("MY_CODE")
        if content == b"boom":
            raise KeyError("x")
        return pd.DataFrame({"v": [float(x) for x in content.split()]})

    known = formats.Formats()
    known.register("mine", F.lit(True), F.lit(0.9), parse, "v double")
    with pytest.raises(ValueError):
        known.register("mine", F.lit(True), F.lit(0.9), parse, "v double")
    rows, issues = known.parse("mine", spark.createDataFrame([(1, b"1 2"), (2, b"bad"), (3, b"boom")], "file_id long, content binary"))
    assert sorted((r["file_id"], r["v"]) for r in rows.collect()) == [(1, 1.0), (1, 2.0)]
    assert sorted((r["file_id"], r["code"]) for r in issues.collect()) == [(2, "MY_CODE"), (3, "ADAPTER_UNEXPECTED_ERROR")]


def test_streaming(spark, folder, tmp_path):
    seen = []
    for _ in range(2):
        query = ingest.consolidate(ingest.stream_sources(spark, folder, "*.tsv"), lambda paths, n: seen.append((n, len(paths))), f"{tmp_path}/checkpoint")
        query.awaitTermination(60)
    assert seen == [(0, 1)]
