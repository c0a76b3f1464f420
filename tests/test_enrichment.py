import json
from datetime import datetime as D

from tidemark.operators import enrichment as en

ROWS = "captured_at timestamp, row_ix long, payload string"
G = "00000000-0000-0000-0000-00000000000{}"


def device(ix, at, **cells):
    return (at, ix, json.dumps({"OperatingSystem": "Windows 11", **cells}))


def ask(spark, users, devices, names, records):
    return en.user_devices_at(
        spark.createDataFrame(users, "user_id string, target timestamp"), spark.createDataFrame(devices, ROWS), spark.createDataFrame(names, "kind string, value string, owner string, observed_at timestamp"),
        spark.createDataFrame([("a",), ("b",)], "user_id string"), spark.createDataFrame(records, ROWS),
    )


def test_devices_links_matches_and_errors(spark):
    one, two, late = D(2026, 1, 1), D(2026, 1, 5), D(2026, 1, 9)
    devices = [
        device(0, one, AzureADDeviceId=G.format(1), UserId="a", Model="first"), device(1, one, AzureADDeviceId=G.format(1), UserId="a", Model="second"), device(2, one, AzureADDeviceId=G.format(2), UserPrincipalName="B@x"),
        device(3, one, SerialNumber="s3", UserId="a", UserPrincipalName="b@x"), device(4, one, UserId="a"), device(5, one, AzureADDeviceId=G.format(5), UserId="a", OperatingSystem="macOS"),
        device(0, two, AzureADDeviceId=G.format(1), UserId="a"), (two, 1, None), (two, 2, "[1]"), (two, 3, "{"),
    ]
    records = [(one, 0, json.dumps({"AzureADDeviceId": G.format(1), "GroupTag": "g"})), (one, 1, json.dumps({"AzureADDeviceId": G.format(2)})), (one, 2, json.dumps({"AzureADDeviceId": G.format(2)}))]
    users = [("a", one), ("a", one), ("b", one), ("c", one), ("a", late), ("a", D(2025, 1, 1)), (None, one)]
    got = {(r.user_id, r.target): r for r in ask(spark, users, devices, [("upn", "b@x", "b", D(2025, 6, 1))], records).collect()}
    assert len(got) == 6
    a, b = got["a", one], got["b", one]
    assert a.coverage == "populated" and a.error is None and [d.device for d in a.devices] == ["aad:" + G.format(1), "aad:" + G.format(5)]
    assert dict(a.devices[0].properties)["Model"] == "first" and a.devices[0].match.status == "matched" and dict(a.devices[0].match.properties)["GroupTag"] == "g"
    assert a.devices[1].match.status == "not_applicable" and a.devices[1].match["keys"] is None
    assert [d.match.status for d in b.devices] == ["ambiguous"] and {k.kind: k.state for k in b.devices[0].match["keys"]}["azure_ad_device_id"] == "ambiguous"
    assert len(a.unresolved) == 1 and a.unresolved == b.unresolved
    assert got["c", one].coverage == got["", one].coverage == "known_zero" and got["c", one].devices == []
    assert got["a", D(2025, 1, 1)].coverage == "no_coverage"
    bad = got["a", late]
    assert (bad.coverage, bad.devices, bad.unresolved, bad.error) == ("error", None, None, "3 rows can't be read")
    states = spark.createDataFrame([("a", late, "present"), ("z", late, "absent")], "entity string, target timestamp, presence string")
    kept = {r.entity: r for r in en.with_enrichment(states, ask(spark, users, devices, [], records)).collect()}
    assert kept["a"].presence == "present" and kept["a"].enrichment_error and kept["z"].device_coverage == "no_coverage" and kept["z"].enrichment_error is None


def test_without_rows(spark):
    (row,) = ask(spark, [("a", D(2026, 1, 1))], [], [], []).collect()
    assert (row.coverage, row.devices, row.unresolved, row.error) == ("no_coverage", [], [], None)
