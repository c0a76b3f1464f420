"""The fields of an entity's card: which columns of which families say them, in order of authority, under which label and section."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cells
from ..operators import identity

# Short names of the families below.
FAMILIES = {
    "properties": "Entra_Users_Properties", "activity": "Entra_Users_Activity", "methods": "Entra_Users_AuthenticationMethods", "roles": "Entra_Role_Assignments", "groups": "Entra_Group_User_Memberships",
    "packages": "Entra_AccessPackage_User_Assignments", "compliance": "Intune_ManagedDevices_Compliance", "autopilot": "Intune_Devices_Autopilot", "ios": "Intune_iOS_Devices", "android": "Intune_Android_Devices",
    "mailboxes": "Exchange_SharedMailboxes",
}

# Key, label, section, and the columns that say the field, the most authoritative first. A key may take several
# lines, where a family shows it in another section; the authority goes on over its lines.
FIELDS = {
    "user": """
        user_immutable_id | Immutable ID | identity | properties.Id activity.UserId
        upn | UPN | identity | properties.UPN activity.UPN methods.UPN roles.UserPrincipalName groups.UserPrincipalName packages.UserPrincipalName
        display_name | Display name | identity | properties.DisplayName activity.DisplayName methods.DisplayName roles.DisplayName
        user_type | User type | identity | properties.UserType activity.UserType methods.UserType
        account_enabled | Account enabled | identity | properties.AccountEnabled activity.AccountEnabled methods.AccountEnabled
        given_name | Given name | identity | properties.GivenName
        surname | Surname | identity | properties.Surname
        mail_nickname | Mail nickname | identity | properties.MailNickname
        identities | Identities | identity | properties.Identities
        on_premises_immutable_id | On-premises immutable ID | identity | properties.OnPremisesImmutableId
        on_premises_dn | On-premises DN | identity | properties.OnPremisesDistinguishedName
        created_date | Created date | identity | properties.CreatedDateTime activity.CreatedDateTime
        mail | Mail | organization | properties.Mail activity.Mail
        job_title | Job title | organization | properties.JobTitle activity.JobTitle methods.JobTitle
        company_name | Company | organization | properties.CompanyName activity.CompanyName methods.CompanyName
        department | Department | organization | properties.Department activity.Department methods.Department
        office_location | Office location | organization | properties.OfficeLocation
        employee_id | Employee ID | organization | properties.EmployeeId
        employee_type | Employee type | organization | properties.EmployeeType
        employee_hire_date | Employee hire date | organization | properties.EmployeeHireDate
        usage_location | Usage location | organization | properties.UsageLocation
        preferred_language | Preferred language | organization | properties.PreferredLanguage
        preferred_data_location | Preferred data location | organization | properties.PreferredDataLocation
        manager_display_name | Manager | organization | properties.ManagerDisplayName
        manager_upn | Manager UPN | organization | properties.ManagerUPN
        sponsors | Sponsors | organization | properties.Sponsors
        country | Country | organization | properties.Country activity.Country methods.Country
        city | City | organization | properties.City activity.City methods.City
        street_address | Street address | organization | properties.StreetAddress
        state | State / province | organization | properties.State
        postal_code | Postal code | organization | properties.PostalCode
        business_phones | Business phones | organization | properties.BusinessPhones
        mobile_phone | Mobile phone | organization | properties.MobilePhone
        other_mails | Other mails | organization | properties.OtherMails
        proxy_addresses | Proxy addresses | organization | properties.ProxyAddresses
        im_addresses | IM addresses | organization | properties.IMAddresses
        on_premises_sync_enabled | On-premises sync enabled | organization | properties.OnPremisesSyncEnabled
        on_premises_sync_enabled | On-premises sync enabled | authentication | activity.OnPremisesSyncEnabled
        on_premises_last_sync | On-premises last sync | organization | properties.OnPremisesLastSyncDateTime
        extension_attributes | Extension attributes | organization | properties.ExtensionAttributes
        last_password_change | Last password change | authentication | activity.LastPasswordChangeDateTime
        last_interactive_sign_in | Last interactive sign-in | authentication | activity.LastInteractiveSignInDateTime
        last_non_interactive_sign_in | Last non-interactive sign-in | authentication | activity.LastNonInteractiveSignInDateTime
        last_successful_sign_in | Last successful sign-in | authentication | activity.LastSuccessfulSignInDateTime
        mfa_registered | MFA registered | authentication | methods.IsMfaRegistered
        mfa_capable | MFA capable | authentication | methods.IsMfaCapable
        passwordless_capable | Passwordless capable | authentication | methods.IsPasswordlessCapable
        default_mfa_method | Default MFA method | authentication | methods.DefaultMfaMethod
        authentication_methods | Authentication methods | authentication | methods.AuthenticationMethods methods.MethodsRegistered
        sspr_registered | SSPR registered | authentication | methods.IsSsprRegistered
        sspr_enabled | SSPR enabled | authentication | methods.IsSsprEnabled
        sspr_capable | SSPR capable | authentication | methods.IsSsprCapable
        is_admin | Is admin | authentication | methods.IsAdmin
        system_preferred_auth_enabled | System preferred auth enabled | authentication | methods.IsSystemPreferredAuthenticationMethodEnabled
        user_preferred_secondary_auth | User preferred secondary auth | authentication | methods.UserPreferredMethodForSecondaryAuthentication
        system_preferred_auth_method | System preferred auth method | authentication | methods.SystemPreferredAuthenticationMethod methods.SystemPreferredAuthenticationMethods
        auth_report_last_updated | Auth report last updated | authentication | methods.LastUpdatedDateTime
    """,
    "device": """
        device_entra_id | Entra device ID | identity | compliance.AzureADDeviceId autopilot.AzureADDeviceId ios.EntraDeviceId android.EntraDeviceId
        device_managed_id | Managed device ID | identity | compliance.ManagedDeviceId
        device_name | Device name | identity | compliance.DeviceName ios.DeviceName android.DeviceName autopilot.DisplayName
        manufacturer | Manufacturer | identity | android.Manufacturer ios.Manufacturer
        manufacturer | Manufacturer | management | autopilot.Manufacturer
        model | Model | identity | android.Model ios.Model
        model | Model | management | autopilot.Model
        serial_number | Serial number | ownership | compliance.SerialNumber autopilot.SerialNumber ios.SerialNumber android.SerialNumber
        compliance_state | Compliance state | os_compliance | compliance.ComplianceState ios.ComplianceState android.ComplianceState
        operating_system | Operating system | os_compliance | compliance.OperatingSystem ios.OperatingSystem android.OperatingSystem
        os_version | OS version | os_compliance | android.OSVersion
        android_security_patch | Android security patch | os_compliance | android.AndroidSecurityPatchLevel
        compliance_grace_expiration | Compliance grace expiration | os_compliance | android.ComplianceGracePeriodExpiration
        rooted | Rooted | os_compliance | android.Rooted
        is_encrypted | Encrypted | os_compliance | android.IsEncrypted
        partner_threat_state | Partner threat state | os_compliance | android.PartnerReportedThreatState
        intune_device_id | Intune device ID | management | android.IntuneDeviceId ios.IntuneDeviceId
        autopilot_id | Autopilot ID | management | autopilot.AutopilotObjectId
        enrollment_state | Enrollment state | management | autopilot.EnrollmentState
        owner_type | Owner type | management | android.OwnerType
        management_agent | Management agent | management | android.ManagementAgent
        device_enrollment_type | Device enrollment type | management | android.DeviceEnrollmentType
        enrollment_profile | Enrollment profile | management | android.EnrollmentProfileName
        device_registration_state | Registration state | management | android.DeviceRegistrationState
        enrolled_date | Enrolled date | management | android.EnrolledDateTime
        management_cert_expiration | Management certificate expiration | management | android.ManagementCertificateExpiration
        azure_ad_registered | Azure AD registered | management | android.AzureADRegistered
        eas_activated | EAS activated | management | android.EASActivated
        eas_device_id | EAS device ID | management | android.EASDeviceId
        eas_activation_date | EAS activation date | management | android.EASActivationDateTime
        last_sync | Last sync | activity | android.LastSyncDateTime
        days_since_last_sync | Days since last sync | activity | android.DaysSinceLastSync
        device_activity_status | Activity status | activity | android.DeviceActivityStatus
        phone_number | Phone number | connectivity | android.PhoneNumber
        imei | IMEI | connectivity | android.IMEI
        meid | MEID | connectivity | android.MEID
        iccid | ICCID | connectivity | android.ICCID
        subscriber_carrier | Carrier | connectivity | android.SubscriberCarrier
        wifi_mac_address | Wi-Fi MAC | connectivity | android.WiFiMacAddress
        total_storage_gb | Total storage (GB) | storage | android.TotalStorageGB
        free_storage_gb | Free storage (GB) | storage | android.FreeStorageGB
    """,
    "shared_mailbox": """
        mailbox_immutable_id | Immutable ID | identity | mailboxes.ExternalDirectoryObjectId
        display_name | Display name | identity | mailboxes.DisplayName
        primary_smtp | Primary SMTP | addresses | mailboxes.PrimarySmtpAddress
        alias | Alias | addresses | mailboxes.Alias
        has_forwarding | Has forwarding | delegation | mailboxes.HasForwarding
        forwarding_smtp | Forwarding SMTP | delegation | mailboxes.ForwardingSmtpAddress
        has_full_access_delegates | Has full access delegates | delegation | mailboxes.HasFullAccessDelegates
        full_access_delegates | Full access delegates | delegation | mailboxes.FullAccessDelegates
        litigation_hold_enabled | Litigation hold | settings | mailboxes.LitigationHoldEnabled
    """,
}

# Columns that are no field of a card and no further detail either.
EXCLUDED = {
    "user": """properties.ManagerStatus properties.ManagerError properties.SponsorsStatus properties.SponsorsError methods.PrefsStatus methods.PrefsError methods.MethodsStatus methods.MethodsError
        methods.MicrosoftReportId methods.ReportSource groups.UserId packages.UserId""",
}

# Sections in the order of a card, with their titles. Further details of devices and mailboxes come last.
SECTIONS = {
    "user": ("identity", "organization", "authentication", "additional_details", "roles", "groups", "access_packages"),
    "device": ("identity", "ownership", "os_compliance", "management", "activity", "connectivity", "storage", "additional_details"),
    "shared_mailbox": ("identity", "addresses", "delegation", "settings", "activity", "additional_details"),
}
TITLES = {
    "identity": "Identity", "organization": "Organization", "authentication": "Authentication and activity", "roles": "Roles", "groups": "Groups", "access_packages": "Access packages", "ownership": "Ownership",
    "os_compliance": "OS & compliance", "management": "Management", "activity": "Activity", "connectivity": "Cellular / network", "storage": "Storage", "addresses": "Addresses", "delegation": "Delegation",
    "settings": "Settings", "additional_details": "Additional details",
}
#: Fields that no scalar value settles; `resolve.merge_methods` does.
MERGED = ("authentication_methods",)
#: The section of what no field is bound to.
REST = "additional_details"


@dataclass(frozen=True)
class Field:
    """A line of the registry: a field of a type of entity, and the (family, column) pairs that say it."""

    entity_type: str
    key: str
    label: str
    section: str
    sources: tuple[tuple[str, str], ...]


def _pairs(text: str) -> tuple[tuple[str, str], ...]:
    return tuple((FAMILIES[s.split(".", 1)[0]], s.split(".", 1)[1]) for s in text.split())


def fields(lines: dict[str, str] = FIELDS) -> list[Field]:
    """The lines of a registry in order, checked (see `check`)."""
    out = [Field(kind, *(p.strip() for p in line.split("|")[:3]), _pairs(line.split("|")[3])) for kind, text in lines.items() for line in text.strip().splitlines()]
    check(out)
    return out


def check(lines: list[Field], adapters: tuple[identity.Adapter, ...] = identity.ADAPTERS) -> None:
    """ValueError if a column is bound twice or to a family of another type, a key has two labels, or a section is unknown."""
    types = {a.family: a.entity_type for a in adapters}
    bound = Counter((f.entity_type, *s) for f in lines for s in f.sources)
    labels = {(f.entity_type, f.key, f.label) for f in lines}
    wrong = [f"{b} is bound {n} times" for b, n in bound.items() if n > 1]
    wrong += [f"{k} has several labels" for k, n in Counter((t, k) for t, k, _ in labels).items() if n > 1]
    wrong += [f"{f.key}: no section {f.section}" for f in lines if f.section not in SECTIONS.get(f.entity_type, ()) or f.section not in TITLES]
    wrong += [f"{f.key}: {family} does not describe a {f.entity_type}" for f in lines for family, _ in f.sources if types.get(family) != f.entity_type]
    wrong += [f"{f.key} has no source" for f in lines if not f.sources]
    if wrong:
        raise ValueError("; ".join(wrong))


def registry(spark: SparkSession, lines: list[Field] | None = None) -> DataFrame:
    """entity_type, family, name, key, label, section, place (of the section on a card), rank: a row for each bound column.

    Ranks run over the sources of a key in the order of its lines. The table is as large as the registry, whatever the data.
    """
    merged: dict[tuple[str, str], list] = {}
    for f in lines or fields():
        merged.setdefault((f.entity_type, f.key), []).extend((*s, f.label, f.section, SECTIONS[f.entity_type].index(f.section)) for s in f.sources)
    rows = [(*k, v) for k, v in merged.items()]
    keys = spark.createDataFrame(rows, "entity_type string, key string, sources array<struct<family: string, name: string, label: string, section: string, place: int>>")
    return keys.select("entity_type", "key", F.posexplode("sources").alias("rank", "s")).select("entity_type", "s.family", "s.name", "key", "s.label", "s.section", "s.place", "rank")


def exclusions(spark: SparkSession) -> DataFrame:
    """entity_type, family, name of the columns that cards leave out."""
    return spark.createDataFrame([(kind, *p) for kind, text in EXCLUDED.items() for p in _pairs(text)], "entity_type string, family string, name string")


def spoken(name: str) -> Column:
    """A column's name in words."""
    return F.trim(F.replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), F.lit("_"), F.lit(" ")))


def facts(rows: DataFrame, adapter: identity.Adapter, *keep: str) -> DataFrame:
    """entity_type, entity, family, name, value and the kept columns of a family's rows: a row for each filled card property; rows without an entity say nothing."""
    own = rows.select(adapter.key(rows.columns).alias("entity"), adapter.card(rows.columns).alias("_card"), *keep).filter("entity is not null")
    return own.select(F.lit(adapter.entity_type).alias("entity_type"), "entity", F.lit(adapter.family).alias("family"), F.inline("_card"), *keep)


def entity_card(said: DataFrame, bindings: DataFrame, left_out: DataFrame, *by: str) -> DataFrame:
    """One row for each field of an entity's card: entity_type, entity, *by, place, section, key, label, value, family, sources, conflicts.

    said: entity_type, entity, family, name, value and *by (such as a target time). The value of the lowest rank counts; equal
    values are one, whoever says them: `sources` has their families, sorted. Other values are `conflicts` (rank, value, family),
    each under its best source, in order. A field stands in the section of its last source that has a value. What no field
    binds becomes additional:<family>:<name> under the column's name in words. Blank values say nothing; ties of rank go to the
    smaller value.

    The registry's two tables are bounded by its lines and joined by broadcast; the groups are an entity's fields, whose
    values are merged by partial aggregates before they meet.
    """
    ids = ["entity_type", "entity", *by]
    filled = said.select(*ids, "family", "name", cells.filled("value").alias("value")).filter("value is not null")
    known = F.broadcast(bindings.filter(~F.col("key").isin(*MERGED)).unionByName(_settled(bindings, left_out)))
    placed = filled.join(known, ["entity_type", "family", "name"], "left").filter("coalesce(key, '') <> '-'")
    rest = F.create_map(*(F.lit(x) for kind, names in SECTIONS.items() for x in (kind, names.index(REST))))
    placed = placed.select(
        *ids, "family", "value", F.coalesce("key", F.concat_ws(":", F.lit("additional"), "family", "name")).alias("key"), F.coalesce("label", spoken("name")).alias("label"), F.coalesce("section", F.lit(REST)).alias("section"),
        F.coalesce("place", F.try_element_at(rest, F.col("entity_type"))).alias("place"), F.coalesce("rank", F.lit(0)).alias("rank"),
    )
    values = placed.groupBy(*ids, "key", "value").agg(F.min(F.struct("rank", "family")).alias("best"), F.max(F.struct("rank", "section", "place")).alias("where"), F.collect_set("family").alias("families"), F.min("label").alias("label"))
    one = F.struct(F.col("best.rank").alias("rank"), "value", F.col("best.family").alias("family"))
    cards = values.groupBy(*ids, "key").agg(F.array_sort(F.collect_list(one)).alias("said"), F.min_by("families", one).alias("families"), F.max("where").alias("where"), F.min("label").alias("label"))
    first = F.col("said")[0]
    return cards.select(
        "entity_type", "entity", *by, F.col("where.place").alias("place"), F.col("where.section").alias("section"), "key", "label", first.value.alias("value"), first.family.alias("family"),
        F.array_sort("families").alias("sources"), F.slice("said", 2, F.greatest(F.size("said") - 1, F.lit(0))).alias("conflicts"),
    )


def _settled(bindings: DataFrame, left_out: DataFrame) -> DataFrame:
    """Bindings under the key `-` of columns that make no field of their own here."""
    columns = left_out.unionByName(bindings.filter(F.col("key").isin(*MERGED)).select("entity_type", "family", "name"))
    none = F.lit(None).cast("string")
    return columns.select("entity_type", "family", "name", F.lit("-").alias("key"), none.alias("label"), none.alias("section"), F.lit(None).cast("int").alias("place"), F.lit(None).cast("int").alias("rank"))
