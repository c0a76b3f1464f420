"""Archives that other software named and wrote."""

import gzip

from tidemark.llm import warc


def test_convert_legacy_archive(spark, tmp_path):
    (tmp_path / "arc").mkdir()
    body = f"1 1 InternetArchive\n{warc.V1_FIELDS}\n<arcmetadata><software>Heritrix</software></arcmetadata>\n"
    head = f"filedesc://IAH-2008.arc 0.0.0.0 20080430204825 text/plain {len(body)}\n{body}\n"
    data = (head + warc.arc_text(1, 7, "http://x/", "legacy page", "20080430204825") + "\n").encode()
    (tmp_path / "arc" / "IAH-2008.arc.gz").write_bytes(gzip.compress(data))
    assert [r.page_id for r in warc.read_arc(spark, f"{tmp_path}/arc").collect()] == [7]
    warc.convert(spark, f"{tmp_path}/arc", f"{tmp_path}/warc")
    got = {r.record_type: r for r in warc.read_warc(spark, f"{tmp_path}/warc").collect()}
    assert set(got) == {"warcinfo", "response"} and all(r.block_digest_ok for r in got.values())
    assert bytes(got["response"].payload) == b"legacy page" and got["warcinfo"].date == "2008-04-30T20:48:25Z"


def pages_of(spark, rows, n=1):
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(n)


def test_archives_are_bounded_and_of_both_versions(spark, tmp_path):
    rows = [(i, f"http://p/{i}", f"{i} " + "x" * 30_000) for i in range(40)]
    warc.write_arc(pages_of(spark, rows), f"{tmp_path}/arc", archive_bytes=100_000)
    arcs = warc.read_arc(spark, f"{tmp_path}/arc").collect()
    assert {r.version for r in arcs} == {1, 2} and sorted(r.page_id for r in arcs) == list(range(40))
    per = {}
    for r in arcs:
        per[r.arc_file] = per.get(r.arc_file, 0) + r.payload_bytes
    assert len(per) >= 10 and max(per.values()) < 140_000
    warc.convert(spark, f"{tmp_path}/arc", f"{tmp_path}/warc", archive_bytes=100_000)
    got = warc.read_warc(spark, f"{tmp_path}/warc").collect()
    assert sum(r.record_type == "warcinfo" for r in got) == len(per) and len({r.warc_file for r in got}) >= 10
    assert {r.page_id: bytes(r.payload).decode() for r in got if r.record_type == "response"} == {i: h for i, _, h in rows}


def test_identifiers_stay_and_twins_are_alike(spark, tmp_path):
    rows = [(1, "http://a", "same"), (1, "http://a", "same"), (2, "http://b", "same"), (3, "http://c", "other")]
    ids = []
    for n in (1, 3):
        warc.write_arc(pages_of(spark, rows, n), f"{tmp_path}/arc{n}")
        warc.convert(spark, f"{tmp_path}/arc{n}", f"{tmp_path}/warc{n}")
        got = [r for r in warc.read_warc(spark, f"{tmp_path}/warc{n}").collect() if r.record_type != "warcinfo"]
        ids.append(sorted((r.page_id, r.record_id) for r in got))
        found = sorted((r.page_id, r.record_type, r.refers_to) for r in warc.page_records(spark, f"{tmp_path}/warc{n}").collect())
        assert found == [(1, "response", None), (1, "response", None), (2, "revisit", 1), (3, "response", None)]
    assert ids[0] == ids[1] and len({i for _, i in ids[0]}) == 3
