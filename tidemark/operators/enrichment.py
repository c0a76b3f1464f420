"""Devices of users at a moment: snapshots in use, links, properties, unresolved links and enrolment matches as one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cells
from ..plans.storage import stored
from . import asof, links

# Columns by which a managed device names its user, and by which it is matched to enrolment records.
LINK_COLUMNS = {"user_id": "UserId", "upn": "UserPrincipalName", "mail": "EmailAddress"}
MATCH_COLUMNS = {"azure_ad_device_id": ("AzureADDeviceId", cells.guid), "managed_device_id": ("ManagedDeviceId", cells.guid), "serial_number": ("SerialNumber", cells.serial)}


def read_payloads(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """rows with `properties`, a map of the cells in their JSON payload, and `unreadable`: the payload is no JSON object.

    A payload that can't be read makes no task fail; its row stays, without properties.
    """
    doc = F.try_parse_json(payload)
    ok = F.coalesce(F.schema_of_variant(doc).startswith("OBJECT"), F.lit(False))
    found = F.when(ok, F.from_json(payload, "map<string,string>"))
    return rows.withColumn("unreadable", ~ok).withColumn("properties", F.coalesce(found, F.create_map().cast("map<string,string>")))


def _cell(name: str) -> Column:
    return cells.text(F.try_element_at("properties", F.lit(name)))


def device_rows(devices: DataFrame, at: str = "captured_at") -> DataFrame:
    """device, captured_at, user_id, upn, mail, properties of readable device rows: the first row, by row_ix, of each device of a snapshot."""
    key = links.device_key(_cell("AzureADDeviceId"), _cell("ManagedDeviceId"), _cell("SerialNumber"), F.lit("Intune_ManagedDevices_Compliance"), _cell("DeviceName"))
    own = devices.filter("not unreadable").select(key.alias("device"), F.col(at).alias(at), "row_ix", *(_cell(c).alias(n) for n, c in LINK_COLUMNS.items()), "properties")
    own = own.filter("device <> 'empty'")
    first = own.groupBy("device", at).agg(F.min_by(F.struct("properties"), "row_ix").alias("_p"))
    return own.drop("properties", "row_ix").distinct().join(first.select("device", at, "_p.properties"), ["device", at])


def enrolment_matches(devices: DataFrame, records: DataFrame) -> DataFrame:
    """device, device_at, record_at, match: struct (status, key states, diagnostic, properties of the matched record).

    devices: device, device_at, record_at (the enrolment snapshot in use, null if none), properties. records: record_at,
    row_ix, properties. Matches of all snapshots are one join: a key's value is taken together with its snapshot. Devices
    that the rules leave out, or that have no enrolment snapshot, are never matched.
    """
    gated = devices.withColumn("gate", links.applicability(_cell("OperatingSystem"), _cell("Model"), F.col("record_at").isNotNull())).withColumn("probe", F.concat_ws("|", "device", F.unix_micros("device_at").cast("string"), F.unix_micros("record_at").cast("string")))
    sought = gated.filter("gate is null").select("probe", "record_at", "properties")
    held = records.withColumn("record", F.concat_ws("|", F.unix_micros("record_at").cast("string"), F.col("row_ix").cast("string")))
    keys = {}
    for kind, (column, norm) in MATCH_COLUMNS.items():
        value = F.nullif(norm(_cell(column)), F.lit(""))
        keys[kind] = (F.coalesce(F.concat(F.unix_micros("record_at").cast("string"), F.lit("|"), value), F.lit("")),) * 2
    found = links.match_records(sought, held, keys, "probe", "record", containing="serial_number")
    found = found.join(held.select(F.col("record").alias("matched"), F.col("properties").alias("_record")), "matched", "left")
    out = gated.drop("properties").join(found, "probe", "left")
    match = F.struct(F.coalesce("gate", "status").alias("status"), F.transform("by_kind", lambda k: F.struct(k.kind.alias("kind"), k.state.alias("state"))).alias("keys"), "diagnostic", F.col("_record").alias("properties"))
    return out.select("device", "device_at", "record_at", match.alias("match"))


def user_devices_at(users: DataFrame, devices: DataFrame, observations: DataFrame, known: DataFrame, records: DataFrame) -> DataFrame:
    """One row for each (user_id, target): device_at, record_at, coverage, devices, unresolved, error.

    users: user_id, target. devices, records: captured_at, row_ix, payload of the device and enrolment families.
    observations: kind, value, owner, observed_at of aliases. known: user_id of all users.

    devices: array of (device, properties, match) in order of device, those that the link ladder gives to the user in the
    newest snapshot not later than the target. unresolved: devices of that snapshot whose link is open and whose candidates
    or link values touch the user. coverage is as in `links.user_devices`. error: null, or how many rows of the snapshots in
    use can't be read; coverage is then `error` and both arrays are null, and the user's state is not touched by it. Users
    without devices have empty arrays. Repeated (user_id, target) rows count once.

    Everything is joined on keys: the snapshots in use are found once a target, by capture times alone, and no payload of
    another snapshot is parsed; links and matches are found once a device and snapshot, however many users and targets ask for them. What several steps read is written to the shared folder: the
    snapshots in use, their device rows and the links.
    """
    users = users.select(cells.text("user_id").alias("user_id"), "target").distinct()
    whole = {"device_at": devices, "record_at": records}
    targets = users.select("target").distinct()
    used = targets
    for name, rows in whole.items():
        family = F.lit(name).alias("family")
        picked = asof.snapshot_asof(rows.select(family, "captured_at").distinct(), targets.select(family, "target"))
        used = used.join(picked.select("target", F.col("used").alias(name)), "target")
    used = stored(used, "snapshots-in-use")
    read = {n: read_payloads(rows.join(used.select(F.col(n).alias("captured_at")).distinct(), "captured_at", "left_semi")) for n, rows in whole.items()}
    failed = {n: rows.filter("unreadable").groupBy(F.col("captured_at").alias(n)).agg(F.count(F.lit(1)).alias(f"_bad_{n}")) for n, rows in read.items()}
    own = stored(device_rows(read["device_at"]).withColumnRenamed("captured_at", "device_at"), "devices-in-use")
    tries = links.attempts(own, observations, known, "device_at")
    merged = stored(links.merge_links(tries, "device_at"), "device-links")
    narrow = own.select("device", "device_at", "properties").dropDuplicates(["device", "device_at"])
    pairs = used.filter("device_at is not null").select("device_at", "record_at").distinct()
    held = read["record_at"].filter("not unreadable").select(F.col("captured_at").alias("record_at"), "row_ix", "properties")
    linked = merged.filter("status = 'resolved'").select("device", "device_at", "user_id").join(users.select("user_id").distinct(), "user_id", "left_semi")
    asked = narrow.join(linked.select("device", "device_at"), ["device", "device_at"], "left_semi").join(pairs, "device_at")
    matches = enrolment_matches(asked, held)
    full = linked.join(narrow, ["device", "device_at"]).join(matches, ["device", "device_at"])
    lists = full.groupBy("user_id", "device_at", "record_at").agg(F.sort_array(F.collect_list(F.struct("device", F.map_entries("properties").alias("properties"), _plain("match").alias("match")))).alias("devices"))

    signals = own.select("device", "device_at", F.explode(F.array(cells.lower("upn"), cells.lower("mail"))).alias("value")).filter("value <> ''")
    names = asof.aliases_at(observations.select(F.col("owner").cast("string").alias("owner"), cells.lower("value").alias("value"), "observed_at"), users.join(used, "target").select(F.col("user_id").alias("owner"), F.col("device_at").alias("target")).filter("target is not null"))
    open_ = merged.filter("status not in ('resolved', 'none')").select("device", "device_at", "candidates")
    by_candidate = open_.select(F.explode("candidates").alias("user_id"), "device", "device_at")
    by_alias = open_.select("device", "device_at").join(signals, ["device", "device_at"]).join(names.select(F.col("owner").alias("user_id"), F.col("target").alias("device_at"), F.explode("values").alias("value")), ["device_at", "value"])
    unresolved = by_candidate.unionByName(by_alias.select("user_id", "device", "device_at")).groupBy("user_id", "device_at").agg(F.array_sort(F.collect_set("device")).alias("unresolved"))

    out = users.join(used, "target").join(unresolved, ["user_id", "device_at"], "left").alias("u")
    out = out.join(lists.alias("l"), (F.col("u.user_id") == F.col("l.user_id")) & (F.col("u.device_at") == F.col("l.device_at")) & F.col("u.record_at").eqNullSafe(F.col("l.record_at")), "left").select("u.*", "devices")
    for name, count in failed.items():
        out = out.join(count, name, "left")
    bad = F.coalesce("_bad_device_at", F.lit(0)) + F.coalesce("_bad_record_at", F.lit(0))
    error = F.when(bad > 0, F.format_string("%d rows can't be read", bad))
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    coverage = F.when(bad > 0, "error").when(F.col("device_at").isNull(), "no_coverage").when(n("devices") > 0, "populated").when(n("unresolved") > 0, "ambiguous_association").otherwise("known_zero")
    keep = lambda c, t: F.when(bad == 0, F.coalesce(c, F.array().cast(t))).alias(c)
    types = dict(out.dtypes)
    return out.select("user_id", "target", "device_at", "record_at", coverage.alias("coverage"), keep("devices", types["devices"]), keep("unresolved", types["unresolved"]), error.alias("error"))


def _plain(match: str) -> Column:
    """A match whose properties are entries instead of a map, so that structs of it have an order."""
    m = F.col(match)
    return F.struct(m.status.alias("status"), m["keys"].alias("keys"), m.diagnostic.alias("diagnostic"), F.map_entries(m.properties).alias("properties"))


def with_enrichment(states: DataFrame, enrichment: DataFrame, entity: str = "entity", target: str = "target") -> DataFrame:
    """States with their user's devices; a state without enrichment, or whose enrichment failed, stays, with the error beside it."""
    own = enrichment.select(F.col("user_id").alias(entity), F.col("target").alias(target), "devices", "unresolved", F.col("coverage").alias("device_coverage"), F.col("error").alias("enrichment_error"))
    return states.join(own, [entity, target], "left").fillna("no_coverage", ["device_coverage"])
