"""What the library knows of each report family: keys, columns that do not count, sets, guards, labels."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cells
from ..operators import diff, periods


@dataclass(frozen=True)
class Family:
    """keys: a chain (first filled part), or with `every` all parts, or with `optional` a last part that may be blank.

    exclude: columns that differences do not count in. sets, folded: `;` lists that compare as sets, the latter without
    case. errors: lists that may hold an error instead. label: columns of an identity, the first filled one counting; with
    label_to, of a second one behind an arrow.
    """

    keys: tuple[str, ...]
    every: bool = False
    optional: bool = False
    exclude: tuple[str, ...] = ()
    sets: tuple[str, ...] = ()
    folded: tuple[str, ...] = ()
    errors: tuple[str, ...] = ()
    label: tuple[str, ...] = ()
    label_to: tuple[str, ...] = ()


# The families and their columns.
FAMILIES = {
    "Entra_Users_Properties": Family(("Id", "UPN"), exclude=("ManagerStatus", "ManagerError", "SponsorsStatus", "SponsorsError"), sets=("Identities", "BusinessPhones", "OtherMails", "ProxyAddresses", "IMAddresses", "Sponsors"), label=("DisplayName", "UPN")),
    "Entra_Users_Activity": Family(("UserId", "UPN"), label=("DisplayName", "UPN")),
    "Entra_Users_AuthenticationMethods_Hybrid": Family(("MicrosoftReportId", "UPN"), exclude=("LastUpdatedDateTime",), sets=("AuthenticationMethods", "MethodsRegistered", "SystemPreferredAuthenticationMethods", "SystemPreferredAuthenticationMethod"), label=("DisplayName", "UPN")),
    "Entra_Groups_Dependencies": Family(("GroupId",), label=("DisplayName",)),
    "Entra_Group_User_Memberships": Family(("UserId", "GroupId"), every=True, label=("UserDisplayName", "UserPrincipalName", "UserId"), label_to=("GroupName", "GroupMail", "GroupId")),
    "Entra_Access_Packages": Family(("AccessPackageId", "PolicyId"), optional=True, label=("AccessPackageName", "AccessPackageId"), label_to=("PolicyName", "PolicyId")),
    "Entra_Role_Assignments": Family(("AssignmentScheduleId", "UserId"), every=True, exclude=("DisplayName", "UserPrincipalName", "Mail", "AccountEnabled", "RoleName", "SourceGroup"), label=("DisplayName", "UserPrincipalName"), label_to=("RoleName",)),
    "Intune_ManagedDevices_Compliance": Family(("ManagedDeviceId", "AzureADDeviceId", "SerialNumber"), exclude=("DaysSinceLastSync", "LastSyncDateTime"), label=("DeviceName", "SerialNumber", "ManagedDeviceId", "AzureADDeviceId")),
    "Intune_Devices_Autopilot": Family(("AutopilotObjectId", "SerialNumber"), exclude=("LastContactedDateTime", "AssignedUser", "AssignmentStatus", "RecommendedAction"), label=("DisplayName", "SerialNumber", "AutopilotObjectId", "AzureADDeviceId", "ManagedDeviceId")),
    "Intune_Android_Devices": Family(("EntraDeviceId", "IntuneDeviceId", "SerialNumber"), exclude=("DaysSinceLastSync", "LastSyncDateTime"), label=("DeviceName", "SerialNumber", "EntraDeviceId", "IntuneDeviceId")),
    "Intune_iOS_Devices": Family(("EntraDeviceId", "IntuneDeviceId", "SerialNumber", "UDID"), exclude=("DaysSinceLastSync", "LastSyncDateTime", "FreeStorageGB", "ActivationLockBypassCode"), label=("DeviceName", "SerialNumber", "EntraDeviceId", "IntuneDeviceId")),
    "Exchange_SharedMailboxes": Family(
        ("ExternalDirectoryObjectId", "PrimarySmtpAddress"), exclude=("HasFullAccessDelegates", "FullAccessDelegatesCount", "HasSendAsDelegates", "SendAsDelegatesCount", "HasSendOnBehalfDelegates", "SendOnBehalfDelegatesCount", "HasAnyDelegation", "HasForwarding"),
        folded=("FullAccessDelegates", "SendAsDelegates", "SendOnBehalfDelegates"), errors=("FullAccessDelegates", "SendAsDelegates"), label=("DisplayName", "PrimarySmtpAddress", "ExternalDirectoryObjectId"),
    ),
}
# Families compared as others, keys of unknown families, the legacy key of roles, families of documents.
COMPARED_AS = {"Intune_Android_Devices_Report": "Intune_Android_Devices", "Intune_iOS_Devices_Report": "Intune_iOS_Devices"}
GLOBAL_KEYS = ("UserPrincipalName", "UPN", "Id", "DeviceId", "AzureADDeviceId", "EntraDeviceId", "IntuneDeviceId", "SerialNumber", "PrimarySmtpAddress", "GroupId", "AccessPackageId")
LEGACY_ROLE_KEY = ("UserPrincipalName", "RoleName", "RoleState", "AssignmentSource", "SourceGroup")
POLICY_FAMILIES = ("Intune_ConfigurationPolicies",)
_ROLES = "Entra_Role_Assignments"
#: Behind a family's name: its rows by the legacy key.
_LEGACY = "\u001flegacy"


def of(family: str) -> Family | None:
    return FAMILIES.get(COMPARED_AS.get(family, family))


def key_name(family: str, headers: Sequence[str]) -> str:
    """The key column of a family without composite key: the first preferred one there is, else the first header."""
    low, own = {h.lower(): h for h in headers}, of(family)
    return next((low[k.lower()] for k in (own.keys if own else GLOBAL_KEYS) if k.lower() in low), headers[0])


def key(family: str, before: Sequence[str], after: Sequence[str]) -> Column:
    """Key expression for a pair of snapshots. Roles use their stable key only where both snapshots have it."""
    own = of(family)
    get = lambda c: cells.resolve([x for x in after if x in before], c)
    if family == _ROLES:
        both = {x.lower() for x in before} & {x.lower() for x in after}
        if not {"assignmentscheduleid", "userid"} <= both:
            return cells.key_last_optional(*map(get, LEGACY_ROLE_KEY))
    if own is None:
        return cells.filled(F.col(f"`{key_name(family, list(after))}`"))
    if own.optional:
        return cells.key_optional(*map(get, own.keys))
    return cells.key_all(*map(get, own.keys)) if own.every else cells.key_first(*map(get, own.keys))


def guards(family: str, headers: Sequence[str]) -> dict[str, Column]:
    """Columns whose difference is no evidence: lists with an error, manager and sponsors without an answer, names beside a user id."""
    own, have = of(family), set(headers)
    out = {c: diff.failed_retrieval(c) for c in (own.errors if own else ()) if c in have}
    if family == "Entra_Users_Properties":
        for status, columns, missing_is_known in (("ManagerStatus", ("ManagerDisplayName", "ManagerUPN"), True), ("SponsorsStatus", ("Sponsors",), False)):
            unknown = diff.unknown_status(status, missing_is_known) if status in have else F.lit(True)  # no status, no evidence
            out |= {c: unknown for c in columns if c in have}
    if family == "Intune_ManagedDevices_Compliance" and "UserId" in have:
        known = (cells.text(F.col("b.UserId")) != "") | (cells.text(F.col("a.UserId")) != "")
        out |= {c: known for c in ("UserPrincipalName", "UserDisplayName", "EmailAddress") if c in have}
    return out


def unknown(family: str, headers: Sequence[str]) -> dict[str, Column]:
    """Columns and when a row's value is no evidence: the guards of a pair, each side by itself. A missing status column is read as null."""
    own, have = of(family), {h.lower() for h in headers}
    out = {c: F.upper(cells.text(f"`{c}`")).startswith("ERROR:") for c in (own.errors if own else ()) if c.lower() in have}
    if family == "Entra_Users_Properties":
        for status, columns, missing_is_known in (("ManagerStatus", ("ManagerDisplayName", "ManagerUPN"), True), ("SponsorsStatus", ("Sponsors",), False)):
            bad = ~cells.status_known(F.col(f"`{status}`"), missing_is_known) if status.lower() in have else F.lit(True)
            out |= {c: bad for c in columns if c.lower() in have}
    if family == "Intune_ManagedDevices_Compliance" and "userid" in have:
        out |= {c: cells.text("UserId") != "" for c in ("UserPrincipalName", "UserDisplayName", "EmailAddress") if c.lower() in have}
    return out


def says(family: str, columns: Sequence[str], headers: Column | None = None) -> Column:
    """A row's evidence under the family's rules: columns that do not count are left out, sets are sets, guards hold."""
    own = of(family) or Family(())
    skip = {c.lower() for c in own.exclude}
    return diff.evidence([c for c in columns if c.lower() not in skip], headers, own.sets, own.folded, unknown(family, columns))


def row_key(family: str, columns: Sequence[str], stable: bool = True) -> Column:
    """The key of a row in a long history of the family; for roles the stable one or, with stable=False, the legacy one."""
    without = [c for c in columns if c.lower() not in ("assignmentscheduleid", "userid")]
    return key(family, columns, columns) if stable else key(family, without, without)


def history_movement(history: DataFrame, family: str, columns: Sequence[str], headers: str = "headers", at: str = "captured_at", order: str = "row_ix", last: int | None = None) -> DataFrame:
    """Movement of one family's whole history under its rules: seq, added, removed, changed, stable.

    history: rows of all snapshots with the union of their columns, the array of each snapshot's headers, and file order.
    Blank keys drop out, the last of equal keys wins, only columns that both snapshots have are compared. Roles are keyed by
    their stable key between snapshots that both have it, else by the legacy one: both schemes are counted and each pair takes its own.
    """
    numbered = diff.number_snapshots(history.withColumn("family", F.lit(family)), at=at)

    def counted(stable: bool) -> DataFrame:
        rows = numbered.withColumn("_says", says(family, columns, F.col(headers))).withColumn("key", row_key(family, columns, stable)).select("family", "seq", "key", "_says", order)
        return diff.movement(diff.last_row_wins(rows, ["family", "seq", "key"], order), last=last, says=F.col("_says"))

    if family != _ROLES:
        return counted(True).drop("family")
    has = lambda c: F.exists(headers, lambda h: F.lower(h) == c)
    flags = numbered.groupBy("seq").agg(F.bool_and(has("assignmentscheduleid") & has("userid")).alias("_has"))
    pair = flags.join(flags.select((F.col("seq") + 1).alias("seq"), F.col("_has").alias("_had")), "seq").select("seq", (F.col("_has") & F.col("_had")).alias("_stable"))
    both = counted(True).withColumn("_by", F.lit(True)).unionByName(counted(False).withColumn("_by", F.lit(False)))
    return both.join(pair, "seq").filter("_by = _stable").drop("family", "_by", "_stable")


def recent_report(histories: dict[str, DataFrame], reference: Column, partial: DataFrame | None = None, spans: dict[str, int] | None = None, headers: str = "headers", at: str = "captured_at", order: str = "row_ix") -> DataFrame:
    """The recent-changes report of several families, each under its own rules, in one plan: family, period, status, reason, added, removed, changed, place.

    histories: by family, rows of all its snapshots with the union of their columns, each snapshot's headers as an array,
    and file order. Blank keys drop out, the last of equal keys wins, only columns that both snapshots have are compared.
    Roles are keyed by their stable key in pairs that both have it, else by the legacy one: their rows come under both
    schemes, as two families of which each pair takes one. partial: (family, captured_at) of snapshots that were not wholly
    retrieved. Families of documents are not compared by rows, so they are refused.
    """
    if told := [f for f in histories if f in POLICY_FAMILIES]:
        raise ValueError(f"{told[0]} is compared by its documents")
    has = lambda c: F.exists(headers, lambda h: F.lower(h) == c)
    rows = snaps = None
    for family, h in histories.items():
        columns = [c for c in h.columns if c not in (headers, at, order)]
        for stable in (True, False) if family == _ROLES else (True,):
            name = F.lit(family if stable else family + _LEGACY).alias("family")
            own = h.select(name, at, row_key(family, columns, stable).alias("key"), says(family, columns, F.col(headers)).alias("_says"), order)
            rows = own if rows is None else rows.unionByName(own)
        seen = h.groupBy(F.lit(family).alias("family"), at).agg(F.bool_and(has("assignmentscheduleid") & has("userid") | F.lit(family != _ROLES)).alias("_stable"))
        snaps = seen if snaps is None else snaps.unionByName(seen)
    pairs = periods.period_pairs(snaps, reference, spans, at=at)
    for side in ("latest", "baseline"):
        pairs = pairs.join(snaps.select("family", F.col(at).alias(side), F.col("_stable").alias(f"_{side}")), ["family", side], "left")
    both = F.coalesce("_latest", F.lit(True)) & F.coalesce("_baseline", F.lit(True))
    pairs = pairs.withColumn("family", F.when(both, F.col("family")).otherwise(F.concat("family", F.lit(_LEGACY)))).drop("_latest", "_baseline")
    if partial is not None:
        partial = partial.select(F.explode(F.array("family", F.concat("family", F.lit(_LEGACY)))).alias("family"), at)
    found = periods.period_changes(diff.last_row_wins(rows, ["family", at, "key"], order), pairs, at=at, says=F.col("_says"), partial=partial)
    return periods.report_order(found.withColumn("family", F.regexp_replace("family", _LEGACY + "$", "")))


def compare(before: DataFrame, after: DataFrame, family: str, order: str = "row_ix") -> DataFrame:
    """pair_diff under the family's rules. Policy families have no row differences: their documents are compared."""
    if family in POLICY_FAMILIES:
        raise ValueError(f"{family} is compared by its documents")
    own = of(family) or Family(())
    common = [c for c in after.columns if c in before.columns]
    return diff.pair_diff(before, after, key(family, before.columns, after.columns), order, own.exclude, guards(family, common), own.sets, own.folded)


def labelled(compared: DataFrame, family: str) -> DataFrame:
    """identity: from the row after for what was added, before for what was removed, after then before for what changed."""
    own, fields = of(family), {f.name.lower(): f.name for f in compared.schema["a"].dataType.fields}

    def first(side: str, names: Sequence[str]) -> Column:
        there = [cells.filled(F.col(f"{side}.`{fields[n.lower()]}`")) for n in names if n.lower() in fields]
        return F.coalesce(*there) if there else F.lit(None).cast("string")

    def name(side: str) -> Column:
        one = first(side, own.label if own else ())
        return F.when(one.isNotNull() & first(side, own.label_to).isNotNull(), F.concat_ws(" → ", one, first(side, own.label_to))).otherwise(one) if own and own.label_to else one

    return compared.withColumn("identity", F.coalesce(name("a"), name("b"), F.col("key")))
