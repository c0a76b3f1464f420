"""Entities over all their occurrences: keys, first and last sight, aliases, search."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cells
from . import grams


@dataclass(frozen=True)
class Alias:
    """A column that names an entity beside its id, and the kind of name it is."""

    kind: str
    column: str


@dataclass(frozen=True)
class Fallback:
    """The key of rows without an id: a column behind a prefix, in lower case if `fold`."""

    prefix: str
    column: str
    fold: bool = False


@dataclass(frozen=True)
class Adapter:
    """How a family's rows name their entity: id columns, aliases, display column, row scope, the columns of its card, and what stands in for a missing id."""

    family: str
    entity_type: str
    canonical: tuple[str, ...]
    aliases: tuple[Alias, ...] = ()
    display: str = ""
    scope: tuple[str, ...] = ()
    authoritative: bool = False
    cards: tuple[str, ...] = ()
    fallback: Fallback | None = None

    def supports(self, headers: Sequence[str]) -> bool:
        """Whether a file can be read: it has an id column; an alias column, for a family without id columns; any, where only a fallback is told."""
        low, wanted = {h.lower() for h in headers}, self.canonical or tuple(a.column for a in self.aliases)
        return bool(low & {c.lower() for c in wanted}) if wanted else self.fallback is not None

    @property
    def upn_dependent(self) -> bool:
        """Whether rows name their user by sign-in name alone, so that they are bound by what other families say of it."""
        return not self.canonical and any(a.kind == "upn" for a in self.aliases)

    def _id(self, columns: Sequence[str]) -> Column:
        ids = [F.nullif(cells.resolve(columns, c), F.lit("")) for c in self.canonical]
        return F.coalesce(*ids) if ids else F.lit(None).cast("string")

    def key(self, columns: Sequence[str]) -> Column:
        """Entity key: the first id, devices under `aad:`, else the fallback; null for rows that have neither."""
        main = F.concat(F.lit("aad:"), self._id(columns)) if self.entity_type == "device" else self._id(columns)
        if self.fallback is None:
            return main
        other = F.nullif(cells.resolve(columns, self.fallback.column), F.lit(""))
        return F.coalesce(main, F.concat(F.lit(self.fallback.prefix), F.lower(other) if self.fallback.fold else other))

    def shown(self, columns: Sequence[str]) -> Column:
        """Display name, else the id, else Unknown."""
        return F.coalesce(F.nullif(cells.resolve(columns, self.display), F.lit("")) if self.display else F.lit(None).cast("string"), self._id(columns), F.lit("Unknown"))

    def row_scope(self, columns: Sequence[str]) -> Column:
        """What tells a row from others of its entity: `column: value` of the filled scope columns; blank where there are none."""
        return cells.row_scope(list(self.scope), [cells.resolve(columns, c) for c in self.scope]) if self.scope else F.lit("")

    def card(self, columns: Sequence[str]) -> Column:
        """Filled properties as an array of (name, value): the card's columns in their order, or all but the id columns where there is no list."""
        own = self.cards or tuple(c for c in columns if c not in self.canonical)
        pairs = F.array(*(F.struct(F.lit(c).alias("name"), cells.resolve(columns, c).alias("value")) for c in own)).cast("array<struct<name: string, value: string>>")
        return F.filter(pairs, lambda x: x.value != "")


def _aliases(**kinds: str) -> tuple[Alias, ...]:
    return tuple(Alias(k, c) for k, c in kinds.items())


# The families whose rows describe entities, with their columns in the order of their cards.
ADAPTERS = (
    Adapter(
        "Entra_Users_Properties", "user", ("Id",), _aliases(upn="UPN", mail="Mail"), "DisplayName", (), True,
        ("Id", "UPN", "DisplayName", "GivenName", "Surname", "Mail", "MailNickname", "UserType", "AccountEnabled", "CreatedDateTime", "Identities", "StreetAddress", "City", "State", "PostalCode", "Country", "BusinessPhones",
         "MobilePhone", "OtherMails", "ProxyAddresses", "IMAddresses", "JobTitle", "CompanyName", "Department", "OfficeLocation", "EmployeeId", "EmployeeType", "EmployeeHireDate", "UsageLocation", "PreferredLanguage",
         "PreferredDataLocation", "OnPremisesSyncEnabled", "OnPremisesLastSyncDateTime", "OnPremisesDistinguishedName", "OnPremisesImmutableId", "ExtensionAttributes", "ManagerDisplayName", "ManagerUPN", "Sponsors"),
    ),
    Adapter(
        "Entra_Users_Activity", "user", ("UserId",), _aliases(upn="UPN", mail="Mail"), "DisplayName", (), False,
        ("UserId", "UPN", "DisplayName", "Mail", "UserType", "AccountEnabled", "JobTitle", "CompanyName", "Department", "Country", "City", "CreatedDateTime", "LastPasswordChangeDateTime", "OnPremisesSyncEnabled",
         "LastInteractiveSignInDateTime", "LastNonInteractiveSignInDateTime", "LastSuccessfulSignInDateTime"),
    ),
    Adapter(
        "Entra_Users_AuthenticationMethods", "user", (), _aliases(upn="UPN"), "DisplayName", (), False,
        ("UPN", "DisplayName", "UserType", "AccountEnabled", "JobTitle", "CompanyName", "Department", "Country", "City", "IsSystemPreferredAuthenticationMethodEnabled", "UserPreferredMethodForSecondaryAuthentication",
         "SystemPreferredAuthenticationMethod", "AuthenticationMethods", "IsMfaRegistered", "IsMfaCapable", "IsPasswordlessCapable", "IsSsprRegistered", "IsSsprEnabled", "IsSsprCapable", "DefaultMfaMethod",
         "MethodsRegistered", "SystemPreferredAuthenticationMethods", "LastUpdatedDateTime", "IsAdmin"),
        Fallback("upn_only:Entra_Users_AuthenticationMethods:", "UPN", True),
    ),
    Adapter(
        "Entra_Role_Assignments", "user", (), _aliases(upn="UserPrincipalName"), "DisplayName", ("RoleName",), False,
        ("UserPrincipalName", "DisplayName", "RoleName", "RoleState"), Fallback("upn_only:Entra_Role_Assignments:", "UserPrincipalName", True),
    ),
    Adapter(
        "Entra_Group_User_Memberships", "user", ("UserId",), _aliases(upn="UserPrincipalName"), "UserDisplayName", ("GroupId", "GroupName"), False,
        ("UserId", "UserPrincipalName", "GroupName", "MembershipType"),
    ),
    Adapter(
        "Entra_AccessPackage_User_Assignments", "user", ("UserId",), _aliases(upn="UserPrincipalName"), "UserDisplayName", ("AccessPackageId", "AccessPackageName"), False,
        ("UserId", "UserPrincipalName", "AccessPackageName", "AssignmentState"),
    ),
    Adapter(
        "Intune_ManagedDevices_Compliance", "device", ("AzureADDeviceId",), _aliases(serial_number="SerialNumber", device_name="DeviceName", managed_device_id="ManagedDeviceId"), "DeviceName", (), True,
        ("UserId", "UserPrincipalName", "EmailAddress", "ManagedDeviceId", "AzureADDeviceId", "DeviceName", "SerialNumber", "Manufacturer", "Model", "OperatingSystem", "OSVersion", "ComplianceState", "ManagementAgent",
         "EnrolledDateTime", "LastSyncDateTime", "OwnerType", "JailBroken", "DaysSinceLastSync", "DeviceActivityStatus", "PhoneNumber"),
        Fallback("intune:Intune_ManagedDevices_Compliance:", "ManagedDeviceId"),
    ),
    Adapter(
        "Intune_Devices_Autopilot", "device", ("AzureADDeviceId",), _aliases(serial_number="SerialNumber", device_name="DisplayName", autopilot_id="AutopilotObjectId"), "DisplayName", (), False,
        ("AzureADDeviceId", "ManagedDeviceId", "AutopilotObjectId", "SerialNumber", "DisplayName", "Manufacturer", "Model", "SystemFamily", "SkuNumber", "EnrollmentState", "AssignmentStatus", "GroupTag",
         "PurchaseOrderIdentifier", "LastContactedDateTime", "UserPrincipalName", "AddressableUserName", "AssignedUser", "RecommendedAction", "ResourceName"),
        Fallback("autopilot:", "AutopilotObjectId"),
    ),
    Adapter(
        "Intune_iOS_Devices", "device", ("EntraDeviceId",), _aliases(serial_number="SerialNumber", device_name="DeviceName", intune_device_id="IntuneDeviceId"), "DeviceName", (), False,
        ("EntraDeviceId", "IntuneDeviceId", "DeviceName", "SerialNumber", "ComplianceState", "OperatingSystem"), Fallback("ios_intune:", "IntuneDeviceId"),
    ),
    Adapter(
        "Intune_Android_Devices", "device", ("EntraDeviceId",), _aliases(serial_number="SerialNumber", device_name="DeviceName", intune_device_id="IntuneDeviceId"), "DeviceName", (), False,
        ("DeviceName", "ManagementName", "IntuneDeviceId", "EntraDeviceId", "SerialNumber", "Manufacturer", "Model", "OperatingSystem", "OSVersion", "AndroidSecurityPatchLevel", "UserDisplayName", "UserPrincipalName",
         "EmailAddress", "PhoneNumber", "IMEI", "MEID", "ICCID", "SubscriberCarrier", "WiFiMacAddress", "OwnerType", "ManagementAgent", "DeviceEnrollmentType", "EnrollmentProfileName", "DeviceRegistrationState",
         "EnrolledDateTime", "ManagementCertificateExpiration", "LastSyncDateTime", "DaysSinceLastSync", "DeviceActivityStatus", "ComplianceState", "ComplianceGracePeriodExpiration", "AzureADRegistered", "IsEncrypted",
         "Rooted", "PartnerReportedThreatState", "EASActivated", "EASDeviceId", "EASActivationDateTime", "TotalStorageGB", "FreeStorageGB"),
        Fallback("android_intune:", "IntuneDeviceId"),
    ),
    Adapter(
        "Exchange_SharedMailboxes", "shared_mailbox", ("ExternalDirectoryObjectId",), _aliases(primary_smtp="PrimarySmtpAddress", alias="Alias"), "DisplayName", (), True,
        ("ExternalDirectoryObjectId", "PrimarySmtpAddress", "DisplayName", "Alias", "HasForwarding", "ForwardingSmtpAddress", "HasFullAccessDelegates", "FullAccessDelegates", "LitigationHoldEnabled"),
        Fallback("smtp:", "PrimarySmtpAddress", True),
    ),
)


def seen(occurrences: DataFrame, entity: str = "entity", family: str = "family", at: str = "captured_at", display: str = "display") -> DataFrame:
    """Per entity: first_seen, last_seen, latest_name, present_in_latest (in the newest file of any of its families)."""
    newest = occurrences.groupBy(family).agg(F.max(at).alias("_newest"))
    rows = occurrences.join(newest, family)
    return rows.groupBy(entity).agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.max_by(display, F.when(cells.filled(display).isNotNull(), F.col(at))).alias("latest_name"), F.bool_or(F.col(at) == F.col("_newest")).alias("present_in_latest"))


def alias_seen(aliases: DataFrame, entity: str = "entity", at: str = "observed_at") -> DataFrame:
    """Per (entity, kind, value without case, family): first_seen, last_seen and the first spelling."""
    return aliases.groupBy(entity, "kind", F.lower("value").alias("alias"), "family").agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.min_by("value", at).alias("shown"))


def latest_files(files: DataFrame, family: str = "family", at: str = "captured_at", file: str = "file") -> DataFrame:
    return files.groupBy(family).agg(F.max_by(file, F.struct(at, file)).alias("file"), F.max(at).alias(at))


def statistics(occurrences: DataFrame, entity: str = "entity", file: str = "file") -> DataFrame:
    return occurrences.agg(F.count_distinct(entity).alias("entities"), F.count_distinct(file).alias("files"))


def search(entities: DataFrame, needle: Column, k: int = 50, query: str | None = None) -> DataFrame:
    """Best k entities of each query. entities: entity, display, alias (one row an alias).

    Ranks: exact id 0, alias 1, display 2; prefix of id 3, alias 4, display 5; prefix of a token 6; anywhere 7. The best
    rank of an entity counts, then display, then id. query names a column where many queries are asked at once.
    """
    n = F.lower(needle)
    texts = [cells.lower("entity"), cells.lower("alias"), cells.lower("display")]
    token = F.exists(F.array_union(cells.search_tokens("alias"), cells.search_tokens("display")), lambda t: t.startswith(n))
    rank = F.when(texts[0] == n, 0)
    for i, t in enumerate(texts[1:], 1):
        rank = rank.when(t == n, i)
    for i, t in enumerate(texts, 3):
        rank = rank.when(t.startswith(n), i)
    rank = rank.when(token, 6).when(F.concat_ws(" ", *texts).contains(n), 7)
    by = [query] if query else []
    best = entities.withColumn("rank", rank).filter("rank is not null").groupBy(*by, "entity").agg(F.min("rank").alias("rank"), F.min("display").alias("display"), F.count_if(texts[1].contains(n)).alias("alias_hits"))
    if not by:
        return best.orderBy("rank", F.lower("display"), "entity").limit(k)
    return best.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("rank", F.lower("display"), "entity"))).filter(F.col("place") <= k)


def searched(entity: str = "entity", alias: str = "alias", display: str = "display") -> Column:
    """The text of a name that needles are looked for in."""
    return F.concat_ws(" ", cells.lower(entity), cells.lower(alias), cells.lower(display))


def search_many(entities: DataFrame, asks: DataFrame, query: str, needle: str, k: int = 50) -> DataFrame:
    """`search` for many needles at once. asks: query, needle; an empty needle finds nothing.

    Equal needles are looked for once. Names are dealt out by entity and looked through where they lie: a run of a name that
    begins needles gives its pieces of those needles' lengths, and a piece that is a needle has met it (see `grams.pieces`).
    So what meets is what matches, and only the best k of each needle and task are shuffled. Up to MOST_SENT needles go to all
    tasks; more are shuffled with the pieces. Where names stay and needles come anew, `streaming.search_index` keeps postings.
    """
    own = asks.select(query, F.lower(needle).alias("_n")).filter(f"_n <> '' and `{query}` is not null").distinct()
    needles = own.select("_n").distinct()
    parts = int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = entities.select("entity", "alias", "display").repartition(parts, "entity")
    met = grams.pieces(dealt.withColumn("_text", searched()), "_text", needles, "_n").drop("_text").dropDuplicates(["_n", "entity", "alias", "display"])
    best = search(met, F.col("_n"), k, "_n").join(own, "_n").groupBy(query, "entity").agg(F.min("rank").alias("rank"), F.min("display").alias("display"), F.sum("alias_hits").alias("alias_hits"))
    return best.withColumn("place", F.row_number().over(Window.partitionBy(query).orderBy("rank", F.lower("display"), "entity"))).filter(F.col("place") <= k)


def ambiguous(found: DataFrame) -> DataFrame:
    """Whether a search is ambiguous: two entities or more have the needle in an alias."""
    return found.agg((F.count_if(F.col("alias_hits") > 0) > 1).alias("ambiguous"))


def autocomplete(aliases: DataFrame, prefix: str, k: int = 50, value: str = "value") -> DataFrame:
    """Distinct alias values with the prefix, without case, in order."""
    return aliases.filter(cells.lower(value).startswith(prefix.lower())).groupBy(F.lower(value).alias("folded")).agg(F.min(value).alias("value")).orderBy("folded").limit(k).select("value")


def contains(entities: DataFrame, needle: str, entity_type: str | None = None) -> DataFrame:
    """Entities with the needle in id, alias or display, by display name."""
    rows = entities.filter(F.col("entity_type") == entity_type) if entity_type else entities
    hit = F.concat_ws("\n", cells.lower("entity"), cells.lower("alias"), cells.lower("display")).contains(needle.lower())
    return rows.filter(hit).groupBy("entity").agg(F.min("display").alias("display"))


def distinct_values(rows: DataFrame, c: str) -> DataFrame:
    """Trimmed values of a column, in order, blanks last."""
    return rows.select(cells.text(c).alias("value")).distinct().orderBy(F.col("value") == "", F.lower("value"), "value")
