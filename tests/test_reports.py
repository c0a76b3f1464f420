import csv
from datetime import datetime as D

import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.sources import reports, snapshots


def write(tmp_path):
    (tmp_path / "Rep_20260101-010000.csv").write_bytes("﻿Id;Name\n1;Ann\n\n2;\"B;ob\nx\" \n".encode())
    (tmp_path / "Rep_20260102-010000.csv").write_bytes("Id,Name,Dept\n1,Zoë€,\n3\n4,a,b,c\n".encode("cp1252"))
    (tmp_path / "Rep_20260103-010000.csv").write_text("Id\tName\n")
    (tmp_path / "Odd Name+1_20260101-010000.csv").write_text('Id,"Last, first",Id,,"say ""x"""\n1,"A, B",2,q,z\n3\n')
    (tmp_path / "Empty_20260101-010000.csv").write_text("")
    (tmp_path / "readme.csv").write_text("x\n")


def test_every_dialect_in_one_scan(spark, tmp_path):
    write(tmp_path)
    got = reports.read_reports(spark, str(tmp_path))
    rows = {(r.family, r.captured_at.day, r.row_ix): r for r in got.collect()}
    assert rows["Rep", 1, 1].cells == {"Id": "2", "Name": "B;ob\nx"} and rows["Rep", 1, 0].encoding == "UTF-8"
    assert rows["Rep", 2, 0].cells == {"Id": "1", "Name": "Zoë€", "Dept": ""} and rows["Rep", 2, 1].cells == {"Id": "3", "Name": "", "Dept": ""}
    assert rows["Rep", 2, 2].cells == {"Id": "4", "Name": "a", "Dept": "b"} and rows["Rep", 2, 2].encoding == "windows-1252"
    assert rows["Rep", 3, None].headers == ["Id", "Name"] and rows["Rep", 3, None].delimiter == "\t"
    assert rows["Odd Name+1", 1, 0].cells == {"Last, first": "A, B", "Id": "2", "column3": "q", 'say "x"': "z"} and len(rows) == 8
    want = snapshots.read_family(spark, str(tmp_path), "Rep").select("captured_at", "Id", "Name", "Dept").filter("Id <> ''")
    assert reports.family_rows(got, "Rep", ["id", "NAME", "Dept"]).filter("id is null or NAME is null").count() == 0
    plain = lambda df: sorted((r[0], r[1], r[2], r[3] or "") for r in df.collect())
    assert plain(reports.family_rows(got, "Rep", ["Id", "Name", "Dept"]).drop("path", "row_ix")) == plain(want)
    wide = reports.family_table(got, "Rep")
    assert wide.columns == ["path", "captured_at", "row_ix", "Id", "Name", "Dept"] and plain(wide.drop("path", "row_ix")) == plain(want)
    n = {(r.family, r.captured_at.day): r.row_count for r in reports.header_table(got).collect()}
    assert n == {("Rep", 1): 2, ("Rep", 2): 3, ("Rep", 3): 0, ("Odd Name+1", 1): 2}


def test_many_headers_make_one_scan(spark, tmp_path):
    for i in range(400):
        (tmp_path / f"F{i % 7}_202601{1 + i % 28:02d}-{i % 24:02d}{i % 60:02d}{i // 24:02d}.csv").write_text(f"Id,C{i % 50}\n{i},x{i}\n")
    got = reports.read_reports(spark, str(tmp_path))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Union" not in plan
    assert got.filter("size(cells) = 2").select(F.sum(F.expr("cast(cells['Id'] as long)")), F.count_distinct("headers")).first()[:] == (400 * 399 // 2, 50)


def test_stream_reads_each_file_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write(tmp_path / "in")
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    run = lambda: reports.land(reports.stream_reports(spark, str(tmp_path / "in"), 2), out, mark).awaitTermination()
    run()
    assert spark.read.parquet(out).count() == 8
    (tmp_path / "in" / "Rep_20260104-010000.csv").write_text("Id,Name\n9,New\n")
    run()
    run()
    got = spark.read.parquet(out)
    assert got.count() == 9 and got.filter(F.col("captured_at") == D(2026, 1, 4, 1)).first().cells == {"Id": "9", "Name": "New"}
    same = lambda df: sorted((r.path, -1 if r.row_ix is None else r.row_ix, str(r.cells)) for r in df.collect())
    assert same(got) == same(reports.read_reports(spark, str(tmp_path / "in")))


def test_a_fault_is_the_file_s_own(monkeypatch):
    limit = csv.field_size_limit()
    monkeypatch.setattr(reports, "LONGEST_CELL", 10)
    try:
        batch = pa.RecordBatch.from_pydict({"path": ["a", "b", "c"], "content": [b"Id\n1\n" + b"x" * 11 + b"\n2\n", b"Id,X\n2,3\n", None]})
        rows = [r for b in reports._scan(iter([batch])) for r in b.to_pylist()]
    finally:
        csv.field_size_limit(limit)
    assert [(r["path"], r["row_ix"], bool(r["error"])) for r in rows] == [("a", 0, False), ("a", None, True), ("b", 0, False), ("c", None, False)]


def test_bytes_that_windows_leaves_undefined():
    assert reports.decode(b"\x80\x81\x9d\xe9", "windows-1252") == "€\x81\x9dé" and reports.dialect(b"a;b,c\n\xff")[0] == "windows-1252"
    assert [reports.dialect(h)[1] for h in (b"a,b;c\n", b"a\n", b'"x;y;z",b\n', b"a\tb\tc;d\n")] == [";", ",", ",", "\t"]
