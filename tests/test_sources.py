import hashlib
import json
from datetime import datetime

from pyspark.sql import functions as F

from tidemark.operators import diff
from tidemark.sources import bundles, snapshots
from tidemark.streaming import incremental


def test_csv_folder(spark, tmp_path):
    (tmp_path / "Rep_20260101-010000.csv").write_bytes("﻿Id;Name\n1;Ann\n2;\"B;ob\nx\"\n".encode())
    (tmp_path / "Rep_20260102-010000.csv").write_bytes("Id,Name,Dept\n1,Zoë€,\n".encode("cp1252"))
    (tmp_path / "Rep_20260103-010000.csv").write_text("Id\tName\n")
    (tmp_path / "readme.csv").write_text("x\n")
    cat = {r.seq: (r.family, r.captured_at) for r in snapshots.catalogue(spark, str(tmp_path)).collect()}
    assert cat == {1: ("Rep", datetime(2026, 1, 1, 1)), 2: ("Rep", datetime(2026, 1, 2, 1)), 3: ("Rep", datetime(2026, 1, 3, 1))}
    d = {r.path.rsplit("/", 1)[-1]: (r.encoding, r.delimiter) for r in snapshots.dialects(spark, str(tmp_path)).collect()}
    assert d["Rep_20260101-010000.csv"] == ("UTF-8", ";") and d["Rep_20260102-010000.csv"] == ("windows-1252", ",") and d["Rep_20260103-010000.csv"][1] == "\t"
    rows = snapshots.read_family(spark, str(tmp_path), "Rep")
    assert sorted((r.seq, r.Id, r.Name, r.Dept) for r in rows.collect()) == [(1, "1", "Ann", None), (1, "2", "B;ob\nx", None), (2, "1", "Zoë€", "")]
    day = lambda n: rows.filter(F.col("seq") == n).drop("path", "captured_at", "seq")
    assert diff.counts(diff.pair_diff(day(1), day(2), F.col("Id"), "row_ix", exclude=["Dept"])).first().asDict() == {"added": 0, "removed": 1, "changed": 1, "stable": 0, "total": 2}
    n = {r.path.rsplit("/", 1)[-1]: r.row_count for r in snapshots.with_headers(snapshots.catalogue(spark, str(tmp_path)), rows).collect()}
    assert n["Rep_20260103-010000.csv"] == 0


def test_odd_headers_and_names(spark, tmp_path):
    (tmp_path / "Odd Name+1_20260101-010000.csv").write_text('Id,"Last, first",Id,,"say ""x"""\n1,"A, B",2,q,z\n3\n')
    (tmp_path / "Empty_20260101-010000.csv").write_text("")
    assert [r.delimiter for r in snapshots.dialects(spark, str(tmp_path)).collect()] == [","]
    (row, cut) = snapshots.read_family(spark, str(tmp_path), "Odd Name+1").orderBy("row_ix").collect()
    assert (row["Last, first"], row["Id"], row["column3"], row['say "x"']) == ("A, B", "2", "q", "z") and (cut["Id"], cut["Last, first"], row.seq) == ("", "", 1)
    assert snapshots.header_names("a;A;;b", ";") == (["_repeated0", "A", "column2", "b"], ["A", "column2", "b"])


def test_sinks_mark_sort_and_hash(spark, tmp_path):
    df = spark.createDataFrame([("2", "b", {"z": "1", "a": "2"})], "y string, x string, m map<string,string>")
    snapshots.write_view(df.select("y", "x").coalesce(1), f"{tmp_path}/view")
    (part,) = (tmp_path / "view").glob("part-*.csv")
    assert part.read_bytes() == b"\xef\xbb\xbfy,x\n2,b\n"
    snapshots.write_comparison(df, f"{tmp_path}/json")
    assert [r.value for r in spark.read.text(f"{tmp_path}/json").collect()] == ['{"m":{"a":"2","z":"1"},"x":"b","y":"2"}']
    named = spark.createDataFrame([("Added", "k", "Ann → G", None, None, None)], "change string, key string, identity string, property string, before string, after string")
    snapshots.write_changes(named, f"{tmp_path}/changes")
    assert spark.read.option("header", True).csv(f"{tmp_path}/changes").first().Identity == "Ann → G"
    occ = spark.createDataFrame([("f", "d", "a", " v ", "")], "family string, captured_date string, file string, B string, A string")
    snapshots.write_occurrences(occ, f"{tmp_path}/occ", ["B", "A"])
    r = spark.read.parquet(f"{tmp_path}/occ").first()
    assert r.payload == '{"B":"v"}' and r.row_hash == hashlib.sha256(r.payload.encode()).hexdigest()


def test_entity_histories_merge(spark):
    snaps = spark.createDataFrame([("Entra_Users_AuthenticationMethods", datetime(2026, 1, 1), "a", 1), ("Entra_Users_AuthenticationMethods_Hybrid", datetime(2026, 1, 2), "b", 1), ("Intune_iOS_Devices_Report", datetime(2026, 1, 1), "c", 1)], "family string, captured_at timestamp, path string, seq int")
    assert {r.path: (r.family, r.seq) for r in snapshots.merged_histories(snaps).collect()} == {"a": ("Entra_Users_AuthenticationMethods", 1), "b": ("Entra_Users_AuthenticationMethods", 2), "c": ("Intune_iOS_Devices_Report", 1)}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", None)], "x string, y string")
    snapshots.write_inventory(df, ["Y", "x", "z"], f"{tmp_path}/inv")
    got = spark.read.option("header", True).csv(f"{tmp_path}/inv")
    assert got.columns == ["Y", "x", "z"] and got.count() == 1
    snapshots.write_changes(spark.createDataFrame([("Added", "k", None, None, None)], "change string, key string, property string, before string, after string"), f"{tmp_path}/ch")
    assert spark.read.option("header", True).csv(f"{tmp_path}/ch").columns == list(snapshots.CHANGE_COLUMNS)
    occ = spark.createDataFrame([("f", "d1", "a", 1), ("f", "d2", "b", 2)], "family string, captured_date string, file string, v int")
    snapshots.write_occurrences(occ, f"{tmp_path}/occ")
    snapshots.write_occurrences(occ.filter("file = 'a'").withColumn("v", F.lit(9)), f"{tmp_path}/occ")
    assert sorted(r.v for r in spark.read.parquet(f"{tmp_path}/occ").collect()) == [2, 9]


def bundle(root, name, manifest, policies):
    b = root / name
    (b / "policies").mkdir(parents=True)
    (b / "snapshot_manifest.json").write_text(json.dumps(manifest))
    (b / "inventory.csv").write_text("PolicyKey,JsonRelativePath\n" + "".join(f"{k},policies/{k}.json\n" for k in [*policies, "lost"]) + "blank,\n")
    for k, v in policies.items():
        (b / "policies" / f"{k}.json").write_text(json.dumps(v))


def test_bundles(spark, tmp_path):
    cover = {"cfg": {"status": "success", "count": 2, "exportedCount": 2, "processingErrors": 0}, "bad": {"status": "partial", "count": 2, "exportedCount": 1, "processingErrors": 0}}
    good = {"snapshotSchemaVersion": 1, "policyExportSchemaVersion": 4, "snapshotId": "P_20260101-010000", "capturedAtUtc": "2026-01-01T01:00:00Z", "exportStatus": "complete", "inventoryRelativePath": "inventory.csv", "sourceCoverage": cover}
    bundle(tmp_path, "one", good, {"a": {"policy": {"name": "A"}}, "b": {"policy": {"name": "B"}}})
    bundle(tmp_path, "two", good | {"snapshotSchemaVersion": 9, "snapshotId": "", "capturedAtUtc": "soon"}, {})
    found = bundles.manifests(spark, str(tmp_path))
    got = {r.bundle.rsplit("/", 1)[-1]: (r.captured_at, r.issues) for r in found.collect()}
    assert got["one"] == (datetime(2026, 1, 1, 1), []) and got["two"][1] == ["missing snapshotId", "bad capturedAtUtc", "unsupported snapshot version"]
    assert {(r.source, r.accounting) for r in bundles.source_status(found).collect()} == {("cfg", "complete"), ("bad", "integrity_error")}
    assert sorted(r.PolicyKey for r in bundles.load(spark, str(tmp_path)).collect()) == ["a", "b"]
    cat = spark.createDataFrame([("P_20260101-010000",), ("P_20260102-010000",)], "stem string")
    assert {r.stem[2:10]: (r.usable, r.reason) for r in bundles.anchors(cat, found).collect()} == {"20260101": (True, None), "20260102": (False, "no bundle")}
    files = spark.createDataFrame([("/x/manifest.json",), ("/x/policy_inventory.csv",), ("/y/snapshot_manifest.json",)], "path string")
    assert [r.folder for r in bundles.legacy_exports(files).collect()] == ["/x"]


def test_stream_reads_each_file_once(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()

    def follow():
        incremental.follow(spark, str(src), "Id string, Name string", lambda df, _: df.write.mode("append").parquet(str(out)), str(tmp_path / "cp")).awaitTermination()

    (src / "a.csv").write_text("Id,Name\n1,A\n")
    follow()
    (src / "b.csv").write_text("Id,Name\n2,B\n")
    follow()
    follow()
    assert sorted(r.Id for r in spark.read.parquet(str(out)).collect()) == ["1", "2"]


def test_discovery_and_filters(spark, tmp_path):
    good = {"snapshotSchemaVersion": 1, "policyExportSchemaVersion": 4, "snapshotId": "s1", "capturedAtUtc": "2026-01-01T00:00:00Z", "inventoryRelativePath": "inventory.csv", "exportStatus": "success"}
    for i, (name, manifest) in enumerate({"late": good | {"capturedAtUtc": "2026-02-01T00:00:00Z"}, "early": good | {"assignmentFiltersRelativePath": "own.json"}, "torn": None, "list": [], "none": good | {"capturedAtUtc": "2026-03-01T00:00:00Z"}}.items()):
        (tmp_path / name).mkdir()
        (tmp_path / name / "snapshot_manifest.json").write_text('{"snap' if manifest is None else json.dumps(manifest and manifest | {"snapshotId": f"s{i}"}))
    (tmp_path / "late" / "assignment_filters.json").write_text('{"value": [{"id": "f1"}, {"id": "f2"}]}')
    (tmp_path / "early" / "own.json").write_text('[{"id": "f3"}]')
    (tmp_path / "early" / "assignment_filters.json").write_text('[{"id": "other"}]')
    (tmp_path / "none" / "assignment_filters.json").write_text('{"value": "no list"}')
    found = bundles.manifests(spark, str(tmp_path))
    short = lambda b: b.rsplit("/", 1)[-1]
    use, bad = bundles.discover(found)
    assert [short(r.bundle) for r in use.select("bundle").collect()] == ["early", "late", "none"]
    assert sorted((short(r.bundle), r.issue) for r in bad.collect()) == [("list", "manifest_invalid"), ("torn", "manifest_unreadable")]
    got = bundles.filters(spark, str(tmp_path), found).selectExpr("bundle", "variant_get(filter, '$.id', 'string') as id").collect()
    assert sorted((short(r.bundle), r.id) for r in got) == [("early", "f3"), ("late", "f1"), ("late", "f2")]
