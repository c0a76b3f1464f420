"""Column expressions over text cells: tolerant reads, normal forms, keys and derived columns.

A cell is a string; null and blank mean the same unless a function says otherwise. Everything here is a Column, so it
stays inside generated code and reaches scans as far as Spark can push it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats and word lists that results depend on.
STAMP = r"[-_]?(\d{8})[-_](\d{6})$"
DATE_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm", "dd/MM/yyyy")
NULL_WORDS = ("null", "none", "n/a", "na", "unknown", "unassigned")
MEANINGLESS = ("unknown", "n/a", "na", "none", "null", "-")
TRUE_WORDS = ("true", "1", "yes", "y")
GUID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
SEPARATOR = "\u001f"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(c: Column | str) -> Column:
    """Trimmed cell, null as ''."""
    return F.trim(F.coalesce(col(c).cast("string"), F.lit("")))


def lower(c: Column | str) -> Column:
    """Trimmed, lower-cased cell; lower(), not case folding: ß stays ß."""
    return F.lower(text(c))


def filled(c: Column | str) -> Column:
    """Trimmed cell, blank as null."""
    return F.nullif(text(c), F.lit(""))


def resolve(columns: Sequence[str], name: str) -> Column:
    """The column of this name whatever its case, trimmed; '' where the table has none. Decided when the plan is made."""
    found = next((c for c in columns if c.lower() == name.lower()), None)
    return text(F.col(f"`{found}`")) if found else F.lit("")


def family_of(stem: Column | str) -> Column:
    """Report family: the file stem without its stamp."""
    return F.regexp_replace(F.regexp_replace(col(stem), STAMP, ""), r"[_\- ]+$", "")


def stamp_of(stem: Column | str, modified: Column | None = None) -> Column:
    """Capture time from the file stem, else the modification time."""
    own = F.try_to_timestamp(F.nullif(F.concat(F.regexp_extract(col(stem), STAMP, 1), F.regexp_extract(col(stem), STAMP, 2)), F.lit("")), F.lit("yyyyMMddHHmmss"))
    return F.coalesce(own, modified) if modified is not None else own


def timestamp(c: Column | str) -> Column:
    """ISO (trailing Z too), else one of the fixed formats, else null."""
    t = filled(c)
    return F.coalesce(t.try_cast("timestamp"), *(F.try_to_timestamp(t, F.lit(f)) for f in DATE_FORMATS))


def number(c: Column | str) -> Column:
    return filled(c).try_cast("double")


def whole(c: Column | str, strict: bool = False) -> Column:
    """int(float(x)), or with strict int(x); null where that fails."""
    t = filled(c)
    return F.when(t.rlike(r"^[+-]?\d+$"), t.try_cast("int")) if strict else t.try_cast("double").try_cast("int")


def truthy(c: Column | str, words: Sequence[str] = TRUE_WORDS) -> Column:
    return lower(c).isin(*words)


def tokens(c: Column | str, fold: bool = False) -> Column:
    """`;`-separated set: trimmed, without blanks and repeats, sorted."""
    parts = F.transform(F.split(lower(c) if fold else text(c), ";"), lambda x: F.trim(x))
    return F.array_sort(F.array_distinct(F.filter(parts, lambda x: x != "")))


def tokens_ordered(c: Column | str) -> Column:
    """`;`-separated list, repeats dropped whatever their case, first spelling and order kept."""
    parts = F.filter(F.transform(F.split(text(c), ";"), lambda x: F.trim(x)), lambda x: x != "")
    return F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.array_append(acc, x)))


def same_tokens(a: Column | str, b: Column | str, fold: bool = False) -> Column:
    return tokens(a, fold) == tokens(b, fold)


def guid(c: Column | str) -> Column:
    """Lower-cased GUID; null-like words and anything else are blank."""
    t = lower(c)
    return F.when(t.isin(*NULL_WORDS) | ~t.rlike(GUID), F.lit("")).otherwise(t)


def serial(c: Column | str) -> Column:
    """Lower-cased serial number with single spaces; null-like words are blank."""
    t = F.regexp_replace(lower(c), r"\s+", " ")
    return F.when(t.isin(*NULL_WORDS), F.lit("")).otherwise(t)


def is_email(c: Column | str) -> Column:
    return text(c).rlike(EMAIL)


def search_tokens(c: Column | str) -> Column:
    return F.array_distinct(F.filter(F.split(lower(c), r"[@._\-\s]+"), lambda x: x != ""))


def meaningful(c: Column | str) -> Column:
    return (lower(c) != "") & ~lower(c).isin(*MEANINGLESS)


def key_all(*parts: Column | str) -> Column:
    """Composite key; null unless every part is filled."""
    return F.when(reduce(lambda a, b: a & b, [filled(p).isNotNull() for p in parts]), F.concat_ws(SEPARATOR, *(text(p) for p in parts)))


def key_first(*parts: Column | str) -> Column:
    """First filled part."""
    return F.coalesce(*(filled(p) for p in parts))


def key_optional(main: Column | str, more: Column | str) -> Column:
    """main, with more behind it where more is filled; null without main."""
    return F.when(filled(main).isNotNull(), F.when(filled(more).isNotNull(), F.concat_ws(SEPARATOR, text(main), text(more))).otherwise(text(main)))


def key_last_optional(*parts: Column | str) -> Column:
    """Composite key of which only the last part may be blank."""
    return F.when(reduce(lambda a, b: a & b, [filled(p).isNotNull() for p in parts[:-1]]), F.concat_ws(SEPARATOR, *(text(p) for p in parts)))


def label(*parts: Column | str, by: str = " · ", fallback: Column | str | None = None) -> Column:
    """Filled parts joined; the fallback where there is none."""
    own = F.nullif(F.concat_ws(by, *(filled(p) for p in parts)), F.lit(""))
    return F.coalesce(own, text(fallback)) if fallback is not None else own


def role_path(state: Column | str, source: Column | str, group: Column | str) -> Column:
    """`State · via Group`, else `State · Source`."""
    return F.concat_ws(" · ", filled(state), F.when(filled(group).isNotNull(), F.concat(F.lit("via "), text(group))).otherwise(filled(source)))


def row_scope(names: Sequence[str], columns: Sequence[Column]) -> Column:
    """`Col: v / Col2: v` of the filled columns."""
    return F.concat_ws(" / ", *(F.when(filled(c).isNotNull(), F.concat(F.lit(f"{n}: "), text(c))) for n, c in zip(names, columns, strict=True)))


def scope_map(scope: Column | str) -> Column:
    return F.str_to_map(col(scope), F.lit(" / "), F.lit(": "))


def canonical_json(c: Column) -> Column:
    """Compact JSON with sorted keys of a JSON text; numbers take their shortest form."""
    return F.to_json(F.try_parse_json(c))


def semantic_hash(c: Column) -> Column:
    return F.sha2(canonical_json(c), 256)


def struct_hash(*columns: Column | str) -> Column:
    """SHA-256 of the columns as one JSON object; nulls drop out."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def short_id(c: Column | str) -> Column:
    return F.substring(F.sha2(text(c), 256), 1, 12)


def json_type(v: Column) -> Column:
    """null, boolean, integer, number, string, array or object of a VARIANT."""
    t = F.schema_of_variant(v)
    return (
        F.when(v.isNull() | (t == "VOID"), "null").when(t == "BOOLEAN", "boolean").when(t == "BIGINT", "integer")
        .when(t.rlike("^(DECIMAL|DOUBLE|FLOAT)"), "number").when(t.startswith("ARRAY"), "array").when(t.startswith("OBJECT"), "object").otherwise("string")
    )


def status_known(status: Column | str, missing_is_known: bool = False) -> Column:
    """2xx, and 404 where asked for, tell that a retrieval has answered."""
    n = whole(status, strict=True)
    return F.coalesce(n.between(200, 299) | ((n == 404) & F.lit(missing_is_known)), F.lit(False))


def age_days(now: Column, c: Column | str) -> Column:
    """Whole days from the cell's time to now."""
    return F.floor((now.cast("timestamp").cast("double") - timestamp(c).cast("double")) / 86400)


def activity_bucket(days: Column, names: tuple[str, str, str, str] = ("Never", "Active", "Stale31-90d", "Stale>90d")) -> Column:
    never, active, stale, dead = names
    return F.when(days.isNull(), never).when(days <= 30, active).when(days <= 90, stale).otherwise(dead)


def recommended_action(assigned: Column, enrolled: Column) -> Column:
    return F.when(assigned & enrolled, "Review").when(assigned, "ReadyToUnassign").otherwise("ReadyToAssign")


def platform_of(type_name: Column | str) -> Column:
    t = lower(type_name)
    return F.when(t.rlike("win"), "Windows").when(t.rlike("macos"), "macOS").when(t.rlike("ios|ipad"), "iOS/iPadOS").when(t.rlike("android"), "Android").otherwise("Other")


def group_type(unified: Column, security: Column) -> Column:
    return F.when(unified, "Microsoft 365").when(security, "Security").otherwise("Distribution")


def membership_type(group_types: Column | str) -> Column:
    """Of a group's types, a `;` list."""
    return F.when(F.array_contains(tokens(group_types, True), "dynamicmembership"), "Dynamic").otherwise("Assigned")


def retrieval_status(statuses: Column) -> Column:
    """Roll-up of an array of statuses."""
    has = lambda s: F.array_contains(statuses, s)
    return F.when(F.size(statuses) == 0, "success").when(has("error") & (has("success") | has("partial")), "partial").when(has("error"), "error").when(has("partial"), "partial").otherwise("success")


def delegate_count(c: Column | str) -> Column:
    return F.size(F.filter(tokens(c), lambda x: ~F.upper(x).startswith("ERROR:")))


def has_delegates(*lists: Column | str) -> Column:
    """Whether any list has a delegate; an error is none."""
    return reduce(lambda a, b: a | b, [delegate_count(c) > 0 for c in lists])
