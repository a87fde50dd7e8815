"""Row filters and validation rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import file_extension

# ---- fixed values
EXTENSIONS = "pdf docx doc xlsx xls pptx txt csv md rtf odt png jpg jpeg tiff bmp".split()
ZIP_EXTENSIONS = ("docx", "xlsx", "pptx", "odt")
MOST_NAME_CHARS, MOST_BYTES = 260, 50 * 1024 * 1024
MOST_ZIP_ENTRIES, MOST_ZIP_BYTES = 2000, 300 * 1024 * 1024
IMPORTANCE = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
VISIBILITY = ("private", "department", "organization")
ROLE_RANKS = {"member": 0, "manager": 1, "admin": 2}
#: Least and most characters of fields, by kind of record; those of 0 may be absent.
LENGTHS = {
    "experience": {
        "title": (2, 500), "subject": (0, 255), "problem_description": (10, 5000), "root_cause": (0, 2000),
        "actions_taken": (10, 5000), "results": (0, 2000), "lessons_learned": (10, 3000), "suggestion": (0, 2000),
        "related_equipment": (0, 500), "related_process": (0, 500),
    },
    "knowledge": {"title": (2, 500), "subject": (0, 255), "content": (10, 10000), "summary": (0, 1000)},
    "message": {"content": (1, 5000)},
    "search": {"query": (1, 500)},
}
MOST_TAGS, MOST_TAG_CHARS = 20, 100
# ---- end of fixed values


def live_rows(df: DataFrame, organization_id: str | int) -> DataFrame:
    return df.filter((F.col("organization_id") == organization_id) & F.col("deleted_at").isNull())


def status_filter(df: DataFrame, status: str | None = None) -> DataFrame:
    return df if status is None else df.filter(F.col("status") == status)


def search_audit(events: DataFrame, q: str) -> DataFrame:
    """Events whose actor or resource name contains q, or whose code contains upper q."""
    has = lambda name, what: F.coalesce(F.contains(F.col(name), F.lit(what)), F.lit(False))
    return events.filter(has("actor_name", q) | has("resource_name", q) | has("event_code", q.upper()))


def search_users(users: DataFrame, q: str) -> DataFrame:
    has = lambda name: F.coalesce(F.contains(F.col(name), F.lit(q)), F.lit(False))
    return users.filter(has("name") | has("email") | has("username"))


def upload_problem(name: Column, size: Column, most_bytes: int = MOST_BYTES) -> Column:
    """The first rule that an upload breaks, or null."""
    unsafe = F.contains(name, F.lit("..")) | F.contains(name, F.lit("/")) | F.contains(name, F.lit("\\"))
    return (
        F.when(unsafe, "bad_name")
        .when(F.char_length(name) > MOST_NAME_CHARS, "long_name")
        .when(~file_extension(name).isin(EXTENSIONS), "bad_ext")
        .when(size <= 0, "empty")
        .when(size > most_bytes, "too_big")
    )


def zip_problem(stats: Column) -> Column:
    """The first rule that a zip container breaks, from sources.files.zip_stats, or null."""
    return (
        F.when(~stats["readable"], "corrupt")
        .when(stats["entries"] > MOST_ZIP_ENTRIES, "too_many_entries")
        .when(stats["unsafe_at"] < stats["over_at"], "bad_path")
        .when(stats["over_at"] < stats["entries"], "too_big_unpacked")
    )


def violated_rules(kind: str, df: DataFrame, lengths: dict = LENGTHS) -> Column:
    """Names of the fields of a record that break a rule. Optional fields may be null or no
    columns of df; importance, visibility and tags that are null take their defaults."""
    checks = []
    for field, (least, most) in lengths[kind].items():
        if field not in df.columns and not least:
            continue
        value = F.col(field) if field in df.columns else F.lit(None).cast("string")
        bad = ~F.char_length(value).between(least, most)
        checks.append(F.when(bad | (value.isNull() & F.lit(least > 0)), field))
    for field, allowed in (("importance", IMPORTANCE), ("visibility", VISIBILITY)):
        if field in df.columns and (kind == "experience" or field == "visibility"):
            checks.append(F.when(~F.col(field).isin(*allowed), field))
    if "tags" in df.columns:
        fits = (F.size("tags") <= MOST_TAGS) & F.forall("tags", lambda t: F.char_length(t) <= MOST_TAG_CHARS)
        checks.append(F.when(~fits, "tags"))
    return F.array_compact(F.array(*checks))


def live_sessions(sessions: DataFrame, users: DataFrame, as_of: Column) -> DataFrame:
    """Sessions that are neither revoked nor over, of active users who are not locked."""
    rows = sessions.filter(~F.col("is_revoked") & (F.col("expires_at") > as_of))
    able = users.filter(F.col("is_active") & (F.col("locked_until").isNull() | (F.col("locked_until") <= as_of)))
    return rows.join(able.select(F.col("id").alias("user_id")), "user_id")


def department_access(requests: DataFrame, resources: DataFrame, users: DataFrame) -> DataFrame:
    """Of the requests (user_id, resource_id) those that the department rule allows, within
    the organisation. Repeated requests stay."""
    rank = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in ROLE_RANKS.items() for x in kv)), F.col("u.role")), F.lit(-1))
    own = F.col("r.department_id").isNull() | F.col("r.department_id").eqNullSafe(F.col("u.department_id"))
    return (
        requests.select("user_id", "resource_id")
        .join(users.alias("u"), F.col("user_id") == F.col("u.id"))
        .join(resources.alias("r"), (F.col("resource_id") == F.col("r.id")) & (F.col("u.organization_id") == F.col("r.organization_id")))
        .filter((rank >= 1) | own)
        .select("user_id", "resource_id")
    )


def visible_roles(roles: DataFrame, organization_id: str | int) -> DataFrame:
    """Roles of the organisation, and those of the system."""
    return roles.filter((F.col("organization_id") == organization_id) | F.col("organization_id").isNull())
