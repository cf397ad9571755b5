"""Sectioned texts: rows are dealt out once, and numbered over all of a section's lines."""

from __future__ import annotations

from tallyloom.sources import results


def test_peaks_are_numbered_where_their_lines_are(spark):
    table = "[Peak Table(Ch1)]\r\n# of Peaks\t{0}\r\nPeak#\tR.Time\tI.Time\tF.Time\tArea\tHeight\tName\r\n{1}\r\n\r\n"
    row = lambda k, area, name: f"{k}\t1.5\t1\t2\t{area}\t3\t{name}"
    text = table.format(2, row(1, "1_0", "a") + "\r\n" + row(2, "x", "unknown")) + "[Other]\r\nkey\t1\r\n\r\n" + table.format(1, row(7, "1e2", "b"))
    files = spark.createDataFrame([(1, text.encode()), (2, table.format(1, row(1, "4", "c")).encode())], "file_id long, content binary")
    peaks, _, _ = results.sectioned_result(results.text_lines(files))
    assert peaks._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got = sorted((r["file_id"], r["observation_order"], r["peak_number"], r["area"], r["compound"]) for r in peaks.collect())
    assert got == [(1, 1, 1, 10.0, "a"), (1, 2, 2, None, None), (1, 3, 7, 100.0, "b"), (2, 1, 1, 4.0, "c")]
