from dataclasses import replace

import pytest

from tidemark.plans import fields

SAID = "entity_type string, entity string, family string, name string, value string"
P, A, M = "Entra_Users_Properties", "Entra_Users_Activity", "Entra_Users_AuthenticationMethods"


def cards(spark, rows):
    out = fields.entity_card(spark.createDataFrame(rows, SAID), fields.registry(spark), fields.exclusions(spark)).collect()
    return {(r.entity, r.key): r for r in out}


def test_registry_is_checked(spark):
    lines = fields.fields()
    rows = fields.registry(spark).collect()
    assert len(rows) == sum(len(f.sources) for f in lines) and len({(r.entity_type, r.family, r.name) for r in rows}) == len(rows)
    ranks = {}
    for r in rows:
        ranks.setdefault((r.entity_type, r.key), []).append(r["rank"])
    assert all(sorted(x) == list(range(len(x))) for x in ranks.values())
    upn = [r.family for r in sorted((r for r in rows if r.key == "upn"), key=lambda r: r["rank"])]
    assert upn[:3] == [P, A, M] and len(upn) == 6
    for bad in (replace(lines[0], key="again"), replace(lines[0], sources=((P, "X"),), section="nowhere"), replace(lines[0], sources=(("Intune_iOS_Devices", "X"),)), replace(lines[0], sources=((P, "X"),), label="Other"), replace(lines[0], sources=())):
        with pytest.raises(ValueError):
            fields.check([*lines, bad])


def test_authority_conflicts_and_sections(spark):
    got = cards(spark, [
        ("user", "1", M, "Department", "Sales"), ("user", "1", A, "Department", " Ops "), ("user", "1", P, "Department", ""), ("user", "1", P, "Country", "NO"), ("user", "1", A, "Country", "NO"), ("user", "1", M, "Country", "SE"),
        ("user", "1", P, "OnPremisesSyncEnabled", "True"), ("user", "1", A, "OnPremisesSyncEnabled", "False"), ("user", "2", P, "OnPremisesSyncEnabled", "True"),
        ("user", "1", P, "ManagerStatus", "ok"), ("user", "1", M, "AuthenticationMethods", "sms"), ("user", "1", P, "favouriteColour_now", "red"), ("user", "1", P, "favouriteColour_now", "red"), ("user", "1", P, "Mail", None),
        ("device", "aad:x", "Intune_Devices_Autopilot", "Manufacturer", "Acme"), ("device", "aad:x", "Intune_iOS_Devices", "Manufacturer", "acme"), ("device", "aad:x", "Intune_Devices_Autopilot", "GroupTag", "g"),
    ])
    d = got["1", "department"]
    assert (d.value, d.family, d.section, d.label, d.sources) == ("Ops", A, "organization", "Department", [A])
    assert [(c["rank"], c.value, c.family) for c in d.conflicts] == [(2, "Sales", M)]
    c = got["1", "country"]
    assert (c.value, c.sources) == ("NO", [A, P]) and [x.value for x in c.conflicts] == ["SE"]
    assert got["1", "on_premises_sync_enabled"].section == "authentication" and got["2", "on_premises_sync_enabled"].section == "organization"
    extra = got["1", f"additional:{P}:favouriteColour_now"]
    assert (extra.label, extra.section, extra.value, extra.place) == ("favourite Colour now", "additional_details", "red", 3)
    assert got["aad:x", "manufacturer"].value == "acme" and got["aad:x", "manufacturer"].section == "management"
    assert got["aad:x", "additional:Intune_Devices_Autopilot:GroupTag"].place == 7
    assert {k for e, k in got if e == "1"} == {"department", "country", "on_premises_sync_enabled", f"additional:{P}:favouriteColour_now"}


def test_no_facts_no_cards(spark):
    assert cards(spark, []) == {}
