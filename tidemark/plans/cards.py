"""Dashboard cards as data: each a named count, distinct count or sum over the rows of a snapshot.

A report is detected by its headers; its cards compile to one aggregate over all snapshots of all families at once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import cells

Get = Callable[[str], Column]
#: A rule takes a getter of trimmed cells (blank where the table lacks the column) and gives an aggregate.
Rule = Callable[[Get], Column]


def rows() -> Rule:
    return lambda get: F.count(F.lit(1))


def where(test: Callable[[Get], Column]) -> Rule:
    return lambda get: F.count_if(F.coalesce(test(get), F.lit(False)))


def is_in(c: str, *values: str) -> Rule:
    """Cell, without case, among values."""
    return where(lambda get: F.lower(get(c)).isin(*(v.lower() for v in values)))


def exactly(c: str, value: str) -> Rule:
    return where(lambda get: get(c) == value)


def true(c: str) -> Rule:
    return is_in(c, "true", "yes", "1")


def false(c: str) -> Rule:
    return is_in(c, "false", "no", "0")


def filled(c: str) -> Rule:
    return where(lambda get: get(c) != "")


def blank(c: str) -> Rule:
    return where(lambda get: get(c) == "")


def has(c: str, *needles: str) -> Rule:
    """Cell, without case, contains one of the needles."""
    return where(lambda get: F.lower(get(c)).rlike("|".join(n.lower() for n in needles)))


def distinct(c: str, fold: bool = False) -> Rule:
    """Exact count of distinct filled cells."""
    return lambda get: F.count_distinct(F.nullif(F.lower(get(c)) if fold else get(c), F.lit("")))


def total(c: str) -> Rule:
    return lambda get: F.coalesce(F.sum(cells.whole(get(c))), F.lit(0))


def both(a: Callable[[Get], Column], b: Callable[[Get], Column]) -> Rule:
    return where(lambda get: a(get) & b(get))


def low(c: str, *values: str) -> Callable[[Get], Column]:
    return lambda get: F.lower(get(c)).isin(*values)


def age(c: str, most: int | None = None, more: int | None = None, never_counts: bool = False) -> Rule:
    """Whole days from the cell to the snapshot's capture time: at most, or more than; `never` adds cells without a time."""

    def rule(get: Get) -> Column:
        d = cells.age_days(get("captured_at"), get(c))
        hit = d <= most if most is not None else d > more
        return F.count_if(F.coalesce(hit, F.lit(never_counts)))

    return rule


def larger_distinct(a: str, b: str) -> Rule:
    return lambda get: F.greatest(distinct(a)(get), distinct(b)(get))


@dataclass(frozen=True)
class Report:
    """name; detector over lower-cased headers; cards by title."""

    name: str
    headers: tuple[str, ...]
    least: int
    cards: dict[str, Rule]

    def detects(self, headers: Sequence[str]) -> bool:
        return len({h.lower() for h in headers} & {h.lower() for h in self.headers}) >= self.least


def report(name: str, headers: str, least: int | None, **cards: Rule) -> Report:
    own = tuple(headers.split())
    return Report(name, own, len(own) if least is None else least, {k.replace("_", " "): v for k, v in cards.items()})


_ANDROID = "AndroidSecurityPatchLevel MEID PartnerReportedThreatState DeviceEnrollmentType ManagementCertificateExpiration Rooted"

#: In order of detection; the first that detects wins, and the generic profile is the last resort.
REPORTS = (
    report(
        "Memberships", "UserPrincipalName GroupId GroupName MembershipType", None, Memberships=rows(), Unique_users=distinct("UserId"), Unique_groups=distinct("GroupId"), Members=is_in("UserType", "member"), Guests=is_in("UserType", "guest"),
        Enabled_users=is_in("AccountEnabled", "true"), Disabled_users=is_in("AccountEnabled", "false"), Dynamic=is_in("MembershipType", "dynamic"), Assigned=is_in("MembershipType", "assigned", "static", "direct"), Security_groups=true("SecurityEnabled"),
        Microsoft_365=where(lambda get: F.lower(get("GroupType")).contains("microsoft") | (F.lower(get("GroupType")) == "unified")),
    ),
    report(
        "Role assignments", "UserPrincipalName RoleName RoleState AssignmentSource SourceGroup AccountEnabled", 3, Role_Rows=rows(), Distinct_Users=distinct("UserPrincipalName"), Distinct_Roles=distinct("RoleName"), Source_Groups=distinct("SourceGroup"),
        Active=is_in("RoleState", "active"), Eligible=is_in("RoleState", "eligible"), Direct=is_in("AssignmentSource", "direct"), Group=is_in("AssignmentSource", "group"),
        Direct_Active=both(low("AssignmentSource", "direct"), low("RoleState", "active")), Direct_Eligible=both(low("AssignmentSource", "direct"), low("RoleState", "eligible")),
        Group_Active=both(low("AssignmentSource", "group"), low("RoleState", "active")), Group_Eligible=both(low("AssignmentSource", "group"), low("RoleState", "eligible")), Enabled_rows=true("AccountEnabled"), Disabled_rows=false("AccountEnabled"),
    ),
    report(
        "Authentication methods", "UPN IsMfaRegistered IsMfaCapable IsPasswordlessCapable IsSsprRegistered", 4, Users=rows(), Distinct_UPNs=distinct("UPN", fold=True), Enabled=true("AccountEnabled"), Disabled=false("AccountEnabled"), Members=is_in("UserType", "member"), Guests=is_in("UserType", "guest"),
        MFA_Registered=true("IsMfaRegistered"), MFA_Missing=where(lambda get: ~cells.truthy(get("IsMfaRegistered"))), MFA_Capable=true("IsMfaCapable"), Passwordless_Ready=true("IsPasswordlessCapable"), Passwordless_Missing=where(lambda get: ~cells.truthy(get("IsPasswordlessCapable"))),
        SSPR_Registered=true("IsSsprRegistered"), SSPR_Missing=where(lambda get: ~cells.truthy(get("IsSsprRegistered"))), Admin_Accounts=true("IsAdmin"), Admins_Without_MFA=where(lambda get: cells.truthy(get("IsAdmin")) & ~cells.truthy(get("IsMfaRegistered"))),
        With_Methods=filled("AuthenticationMethods"), Without_Methods=blank("AuthenticationMethods"), Authenticator=has("AuthenticationMethods", "microsoft authenticator"), Phone=has("AuthenticationMethods", "phone", "sms", "voice"), FIDO2=has("AuthenticationMethods", "fido2", "passkey"),
        TAP=has("AuthenticationMethods", "temporary access pass", "tap"), System_Preferred_Enabled=true("IsSystemPreferredAuthenticationMethodEnabled"),
    ),
    report(
        "User activity", "UserId UPN CreatedDateTime LastPasswordChangeDateTime LastInteractiveSignInDateTime LastNonInteractiveSignInDateTime LastSuccessfulSignInDateTime AccountEnabled", None, Users=rows(),
        **{f"Created_{d}": age("CreatedDateTime", most=d) for d in (30, 60, 90, 180)}, **{f"Created_over_{d}": age("CreatedDateTime", more=d) for d in (365, 730)}, **{f"Successful_{d}": age("LastSuccessfulSignInDateTime", most=d) for d in (30, 60, 90, 180)},
        **{f"Inactive_{d}": age("LastSuccessfulSignInDateTime", more=d, never_counts=True) for d in (30, 60, 90, 180)}, Never_Successful=where(lambda get: cells.timestamp(get("LastSuccessfulSignInDateTime")).isNull()), **{f"Successful_over_{d}": age("LastSuccessfulSignInDateTime", more=d) for d in (365, 730)},
    ),
    report(
        "Autopilot", "AutopilotObjectId SerialNumber EnrollmentState AssignmentStatus RecommendedAction GroupTag", 5, Total=rows(), Enrolled=is_in("EnrollmentState", "enrolled"), Assigned=exactly("AssignmentStatus", "Assigned"), Not_Assigned=exactly("AssignmentStatus", "NotAssigned"),
        Ready_To_Assign=exactly("RecommendedAction", "ReadyToAssign"), Ready_To_Unassign=exactly("RecommendedAction", "ReadyToUnassign"), Review=exactly("RecommendedAction", "Review"),
    ),
    report(
        "iOS", "UDID IsSupervised JailBroken ActivationLockBypassCode CellularTechnology", 3, Devices=rows(), Users=distinct("UserPrincipalName"), Models=distinct("Model"), iPhone=has("OperatingSystem", "iphone", "^ios"), iPad=has("OperatingSystem", "ipad"), Compliant=is_in("ComplianceState", "compliant"),
        Non_compliant=where(lambda get: (get("ComplianceState") != "") & (F.lower(get("ComplianceState")) != "compliant")), Supervised=true("IsSupervised"), Not_Supervised=false("IsSupervised"), Encrypted=true("IsEncrypted"), Not_Encrypted=false("IsEncrypted"), Jailbroken=is_in("JailBroken", "true"),
        Activation_Lock_Codes=is_in("HasActivationBypassCode", "yes"), Corporate=has("OwnerType", "compan", "corporate"), Personal=is_in("OwnerType", "personal"), Inactive_90=is_in("DeviceActivityStatus", "inactive>90d", "stale>90d"), Never_synced=has("DeviceActivityStatus", "never"),
    ),
    report(
        "Android", _ANDROID, 3, Devices=rows(), Users=distinct("UserPrincipalName"), Manufacturers=distinct("Manufacturer"), Models=distinct("Model"), Enrollment_types=distinct("DeviceEnrollmentType"), Enrollment_profiles=distinct("EnrollmentProfileName"), Carriers=distinct("SubscriberCarrier"),
        Compliant=is_in("ComplianceState", "compliant"), Non_compliant=where(lambda get: (get("ComplianceState") != "") & (F.lower(get("ComplianceState")) != "compliant")), Encrypted=is_in("IsEncrypted", "true"), Not_Encrypted=is_in("IsEncrypted", "false"), Rooted=is_in("Rooted", "true"),
        Threat_reported=filled("PartnerReportedThreatState"), Patch_known=filled("AndroidSecurityPatchLevel"), IMEI=filled("IMEI"), Phone=filled("PhoneNumber"), ICCID=filled("ICCID"), Corporate=has("OwnerType", "compan", "corporate"), Personal=is_in("OwnerType", "personal"),
        Active=has("DeviceActivityStatus", "^active"), Stale=has("DeviceActivityStatus", "stale"), Inactive=has("DeviceActivityStatus", "^inactive"), Never_synced=has("DeviceActivityStatus", "never"),
    ),
    report(
        "Managed devices", "ManagedDeviceId AzureADDeviceId ManagementAgent ComplianceState OwnerType OperatingSystem LastSyncDateTime", 3, Total=rows(), MDM_managed=has("ManagementAgent", "mdm"), Compliant=is_in("ComplianceState", "compliant"), NonCompliant=is_in("ComplianceState", "noncompliant", "non-compliant"),
        Active=is_in("DeviceActivityStatus", "active"), Stale_31_90=is_in("DeviceActivityStatus", "stale31-90d"), Stale_over_90=is_in("DeviceActivityStatus", "stale>90d"), Company=has("OwnerType", "compan"), Personal=is_in("OwnerType", "personal"),
        Windows=has("OperatingSystem", "windows"), macOS=has("OperatingSystem", "macos"), iOS_iPadOS=has("OperatingSystem", "ios", "ipados"), Android=has("OperatingSystem", "android"),
    ),
    report(
        "Groups", "GroupId FriendlyGroupType MembershipType IsUnified IsDynamic IsTeamsTeam OwnersCount MembersCount UsedInConditionalAccess AssignedRoles", 3, Groups_Total=rows(), Security=true("SecurityEnabled"), Unified=true("IsUnified"), Teams=true("IsTeamsTeam"), Mail_enabled=true("MailEnabled"), Synced=true("OnPremisesSyncEnabled"),
        Dynamic=true("IsDynamic"), Assigned=is_in("MembershipType", "assigned"), Groups_with_Members=where(lambda get: cells.whole(get("MembersCount")) > 0), Empty=where(lambda get: cells.whole(get("MembersCount")) <= 0), With_Owners=where(lambda get: cells.whole(get("OwnersCount")) > 0),
        Without_Owners=where(lambda get: cells.whole(get("OwnersCount")) <= 0), Used_in_CA=true("UsedInConditionalAccess"), Assigned_Roles=filled("AssignedRoles"), Enterprise_Apps=filled("ReferencedInAppRoles"), Access_Packages=filled("ReferencedInAccessPackages"),
    ),
    report(
        "Access packages", "AccessPackageId AccessPackageName CatalogId PolicyId PolicyName PolicyStatus", 3, Packages=larger_distinct("AccessPackageName", "AccessPackageId"), Policies=larger_distinct("PolicyName", "PolicyId"), Catalogs=distinct("CatalogId"), Rows=rows(), Enabled_Policies=is_in("PolicyStatus", "enabled"),
        Disabled_Policies=is_in("PolicyStatus", "disabled"), Packages_with_Enabled=lambda get: F.count_distinct(F.when(F.lower(get("PolicyStatus")) == "enabled", get("AccessPackageId"))), Packages_with_Disabled=lambda get: F.count_distinct(F.when(F.lower(get("PolicyStatus")) == "disabled", get("AccessPackageId"))),
        No_Policy_Rows=where(lambda get: (get("PolicyId") == "") & (get("PolicyName") == "")), Packages_without_Policy=lambda get: F.count_distinct(F.when((get("PolicyId") == "") & (get("PolicyName") == ""), get("AccessPackageId"))),
    ),
    report(
        "Apps", "AppName AppId AppGraphType PublishingState IsAssigned AssignmentCount", None, Apps=rows(), App_Types=distinct("AppGraphType"), Assignment_Rows=total("AssignmentCount"), Published=is_in("PublishingState", "published"), Processing=is_in("PublishingState", "processing"), Assigned=true("IsAssigned"), Unassigned=false("IsAssigned"),
        Required=filled("RequiredGroups"), Available=filled("AvailableGroups"), Uninstall=filled("UninstallGroups"), Excluded=filled("ExcludedGroups"), Group_Targeted=has("AssignmentTargets", "group"), All_Devices=has("AssignmentTargets", "all devices"), All_Licensed_Users=has("AssignmentTargets", "all licensed users", "all users"),
        **{p.replace("/", "_"): exactly("PlatformGuess", p) for p in ("Windows", "iOS/iPadOS", "Android", "macOS", "Other")},
    ),
    report(
        "Shared mailboxes", "PrimarySmtpAddress HasFullAccessDelegates HasSendAsDelegates HasSendOnBehalfDelegates HasAnyDelegation HasForwarding", None, Total=rows(), Any_Delegation=true("HasAnyDelegation"), Full_Access=true("HasFullAccessDelegates"), Send_As=true("HasSendAsDelegates"), Send_on_Behalf=true("HasSendOnBehalfDelegates"),
        No_Delegates=where(lambda get: ~cells.truthy(get("HasAnyDelegation"))), Forwarding=true("HasForwarding"), Without_Full_Access=where(lambda get: F.lower(get("HasFullAccessDelegates")) != "true"), Visible=false("HiddenFromAddressListsEnabled"), Hidden=true("HiddenFromAddressListsEnabled"),
        Litigation_Hold=true("LitigationHoldEnabled"), With_Retention_Policy=where(lambda get: (get("RetentionPolicy") != "") & ~F.lower(get("RetentionPolicy")).startswith("error")),
    ),
    report(
        "Identity", "UserType AccountEnabled OnPremisesSyncEnabled ManagerUPN", 2, Identity_Total=rows(), Enabled=true("AccountEnabled"), Disabled=false("AccountEnabled"), Members=is_in("UserType", "member"), Guests=is_in("UserType", "guest"), Synced=true("OnPremisesSyncEnabled"), Cloud_only=is_in("OnPremisesSyncEnabled", "false", ""),
        **{f"With_{c}": filled(c) for c in ("ManagerUPN", "Department", "JobTitle", "UsageLocation", "CompanyName", "Sponsors")}, **{f"Without_{c}": blank(c) for c in ("ManagerUPN", "Department", "JobTitle", "UsageLocation", "CompanyName", "Sponsors")},
    ),
)


def detect(headers: Sequence[str]) -> Report | None:
    """The first report whose headers are there; None means the generic profile."""
    return next((r for r in REPORTS if r.detects(headers)), None)
