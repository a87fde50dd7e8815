"""Users, roles and permissions; lists of the newest rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.bounds import small
from tidemark.operators.segments import running_number
from tidemark.sources.shared import save

ADMIN_ROLES = ("SUPER_ADMIN", "ORG_ADMIN")


def primary_role(user_roles: DataFrame, roles: DataFrame) -> DataFrame:
    """(user_id, role): the role given last; at equal times the greater role id."""
    last = user_roles.groupBy("user_id").agg(F.max(F.struct("created_at", "role_id"))["role_id"].alias("id"))
    return last.join(roles.select("id", F.col("name").alias("role")), "id").select("user_id", "role")


def user_directory(users: DataFrame, departments: DataFrame, user_roles: DataFrame, roles: DataFrame) -> DataFrame:
    """(id, name, department, role) with "-" and a default role where there is none."""
    names = departments.select(F.col("id").alias("department_id"), F.col("name").alias("department"))
    role = primary_role(user_roles, roles).withColumnRenamed("user_id", "id").withColumnRenamed("role", "own")
    default = F.when(F.col("is_superadmin"), "admin").otherwise("user")
    return users.drop("role").join(names, "department_id", "left").join(role, "id", "left").select(
        "id", "name", F.coalesce("department", F.lit("-")).alias("department"), F.coalesce("own", default).alias("role")
    )


def effective_permissions(
    users: DataFrame, user_roles: DataFrame, role_permissions: DataFrame, permissions: DataFrame
) -> DataFrame:
    """Distinct (user_id, code). A superadmin has every code.

    Each user's roles meet as a set, and each set of roles gets its distinct codes once; users
    are joined to these sets and codes are exploded last, so no task holds the exploded rows.
    """
    codes = permissions.select(F.col("id").alias("permission_id"), "code")
    of_role = role_permissions.join(codes, "permission_id").groupBy("role_id").agg(F.collect_set("code").alias("codes"))
    everything = permissions.agg(F.collect_set("code").alias("codes"))  # one row, the list of codes
    supers = users.filter("is_superadmin").select(F.col("id").alias("user_id"), F.lit(None).alias("role_id"), F.lit(True).alias("anything"))
    held = user_roles.select("user_id", "role_id", F.lit(False).alias("anything")).unionByName(supers)
    held = held.groupBy("user_id").agg(F.sort_array(F.collect_set("role_id")).alias("roles"), F.bool_or("anything").alias("anything"))
    held = save(held, "role-sets")
    sets = save(held.filter("NOT anything").select("roles").distinct(), "distinct-role-sets")
    of_set = sets.select("roles", F.explode("roles").alias("role_id")).join(of_role, "role_id").groupBy("roles").agg(
        F.array_distinct(F.flatten(F.collect_list("codes"))).alias("codes")
    )
    granted = held.filter("NOT anything").join(small(of_set, sets.count(), 4096), "roles")
    supers = held.filter("anything").join(F.broadcast(everything))
    return granted.select("user_id", F.explode("codes").alias("code")).unionByName(supers.select("user_id", F.explode("codes").alias("code")))


def check_permissions(permissions: DataFrame, required: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """(user_id, has_all, has_any) of required (user_id, codes); no grants: denied. With
    users (id, is_superadmin), a superadmin passes whatever is asked, listed or not."""
    own = permissions.groupBy("user_id").agg(F.collect_set("code").alias("own"))
    held = F.coalesce("own", F.array().cast("array<string>"))
    rows, anything = required.join(own, "user_id", "left"), F.lit(False)
    if users is not None:
        supers = users.filter("is_superadmin").select(F.col("id").alias("user_id"), F.lit(True).alias("anything")).distinct()
        rows, anything = rows.join(supers, "user_id", "left"), F.coalesce("anything", F.lit(False))
    return rows.select(
        "user_id",
        (anything | (F.size(F.array_except("codes", held)) == 0)).alias("has_all"),
        (anything | F.coalesce(F.arrays_overlap("codes", held), F.lit(False))).alias("has_any"),
    )


def has_permission(users: DataFrame, permissions: DataFrame, code: str) -> DataFrame:
    """The users who hold the code; superadmins hold every code, listed or not."""
    able = permissions.filter(F.col("code") == code).select(F.col("user_id").alias("id"), F.lit(True).alias("able")).distinct()
    rows = users.join(able, "id", "left")
    return rows.filter(F.coalesce("able", F.lit(False)) | F.col("is_superadmin")).drop("able")


def permitted_requests(requests: DataFrame, permissions: DataFrame, users: DataFrame, codes: dict[str, str], what: str) -> DataFrame:
    """requests (user_id, ...) with permitted: whether the user holds the code that codes
    gives for the value of the column what, or is a superadmin."""
    need = F.element_at(F.create_map(*(F.lit(x) for kv in codes.items() for x in kv)), F.col(what))
    able = permissions.select("user_id", F.col("code").alias("need"), F.lit(True).alias("able")).distinct()
    supers = users.filter("is_superadmin").select(F.col("id").alias("user_id"), F.lit(True).alias("anything")).distinct()
    rows = requests.withColumn("need", need).join(able, ["user_id", "need"], "left").join(supers, "user_id", "left")
    return rows.withColumn("permitted", F.coalesce("able", "anything", F.lit(False))).drop("need", "able", "anything")


def role_matrix(defaults: DataFrame, roles: DataFrame, permissions: DataFrame) -> DataFrame:
    """(role_id, permission_id) of defaults (role, codes); unknown names are skipped."""
    pairs = defaults.select(F.col("role").alias("name"), F.explode("codes").alias("code"))
    return (
        pairs.join(roles.select(F.col("id").alias("role_id"), "name"), "name")
        .join(permissions.select(F.col("id").alias("permission_id"), "code"), "code")
        .select("role_id", "permission_id")
    )


def users_per_role(roles: DataFrame, user_roles: DataFrame) -> DataFrame:
    counts = user_roles.groupBy(F.col("role_id").alias("id")).agg(F.count("*").alias("n"))
    return roles.join(counts, "id", "left").select("id", "name", F.coalesce("n", F.lit(0).cast("long")).alias("users"))


def permissions_per_role(roles: DataFrame, role_permissions: DataFrame, permissions: DataFrame) -> DataFrame:
    """(id, name, codes), codes in order; the list of a role is bounded by all codes."""
    codes = role_permissions.join(permissions.select(F.col("id").alias("permission_id"), "code"), "permission_id")
    listed = codes.groupBy(F.col("role_id").alias("id")).agg(F.sort_array(F.collect_set("code")).alias("codes"))
    none = F.array().cast("array<string>")
    return roles.join(listed, "id", "left").select("id", "name", F.coalesce("codes", none).alias("codes"))


def permission_categories(permissions: DataFrame) -> DataFrame:
    return permissions.select(F.split("code", r"\.")[0].alias("category")).distinct()


def user_roles_summary(users: DataFrame, user_roles: DataFrame, roles: DataFrame) -> DataFrame:
    """(id, roles, is_admin)."""
    named = user_roles.join(roles.select(F.col("id").alias("role_id"), "name"), "role_id")
    listed = named.groupBy(F.col("user_id").alias("id")).agg(
        F.sort_array(F.collect_set("name")).alias("roles"), F.bool_or(F.col("name").isin(*ADMIN_ROLES)).alias("by_role")
    )
    return users.join(listed, "id", "left").select(
        "id",
        F.coalesce("roles", F.array().cast("array<string>")).alias("roles"),
        (F.col("is_superadmin") | F.coalesce("by_role", F.lit(False))).alias("is_admin"),
    )


def with_tags(items: DataFrame, tags: DataFrame) -> DataFrame:
    """items with their tags (item_id, tag) as an array, empty if none."""
    listed = tags.groupBy(F.col("item_id").alias("id")).agg(F.sort_array(F.collect_set("tag")).alias("tags"))
    return items.join(listed, "id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def owned_messages(messages: DataFrame, conversations: DataFrame) -> DataFrame:
    """Messages of conversations, with the owner, and their place in the conversation."""
    own = conversations.select(F.col("id").alias("conversation_id"), "user_id")
    oldest = Window.partitionBy("conversation_id").orderBy("created_at", "id")
    return messages.join(own, "conversation_id").withColumn("place", F.row_number().over(oldest))


def newest_per_tenant(df: DataFrame, stamp: str, tie: str, n: int = 100, tenant: str = "organization_id") -> DataFrame:
    """The n newest rows of each tenant with their rank: planned as a group limit."""
    newest = Window.partitionBy(tenant).orderBy(F.desc(stamp), F.desc(tie))
    return df.withColumn("rank", F.row_number().over(newest)).filter(F.col("rank") <= n)


def audit_feed(events: DataFrame, organization_id=None, n: int = 50) -> DataFrame:
    """The newest events, at most 200."""
    rows = events if organization_id is None else events.filter(F.col("organization_id") == organization_id)
    return rows.orderBy(F.desc("created_at"), F.desc("id")).limit(min(n, 200))


def pending_backlog(jobs: DataFrame, tenant: str = "organization_id") -> DataFrame:
    """Jobs to run, with their place in the tenant's queue, oldest first; a tenant's queue of
    any length spreads over the tasks."""
    rows = jobs.filter((F.col("status") == "PENDING") & (F.col("retry_count") < F.col("max_retries")))
    return running_number(rows, [tenant], ["created_at", "id"], "place")


def scanned_documents(pages: DataFrame, documents: DataFrame, least: int = 20) -> DataFrame:
    """(id, page_count, mean_chars, needs_ocr): few characters a page mean a scan."""
    chars = F.char_length(F.trim(F.coalesce("text", F.lit(""))))
    sums = pages.groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("n"), F.sum(chars).alias("chars"))
    rows = documents.select("id").join(sums, "id", "left")
    mean = F.coalesce(F.col("chars") / F.col("n"), F.lit(0.0))
    return rows.select("id", F.coalesce("n", F.lit(0).cast("long")).alias("page_count"), mean.alias("mean_chars"), (mean < least).alias("needs_ocr"))


def ingest_summary(documents: DataFrame, pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id, page_count, chunk_count, ocr_used, status): failed if a document gave no chunk.
    pages (source_id, page, and ocr_used where some text was recognised, paged where false of
    kinds of files that have no pages) are the extracted ones, with or without chunks; the
    page_count of a kind without pages is null, of a document without pages 0."""
    id_of = F.col("source_id").alias("id")
    ocr = F.bool_or("ocr_used") if "ocr_used" in pages.columns else F.lit(False)
    paged = F.coalesce(F.bool_and("paged"), F.lit(True)) if "paged" in pages.columns else F.lit(True)
    extracted = pages.groupBy(id_of).agg(F.count("*").alias("pages"), ocr.alias("ocr"), paged.alias("paged"))
    counts = chunks.groupBy(id_of).agg(F.count("*").alias("chunks"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    status = F.when(zero("chunks") > 0, "completed").otherwise("failed")
    return documents.select("id").join(extracted, "id", "left").join(counts, "id", "left").select(
        "id", F.when(F.coalesce("paged", F.lit(True)), zero("pages")).alias("page_count"), zero("chunks").alias("chunk_count"),
        F.coalesce("ocr", F.lit(False)).alias("ocr_used"), status.alias("status"),
    )


def conversation_rollup(messages: DataFrame) -> DataFrame:
    """(conversation_id, title, message_count, last_turn): the title is the first
    question's start; the first question counts 1, each later one 2."""
    asked = F.col("role") == "user"
    n = F.count_if(asked)
    return messages.groupBy("conversation_id").agg(
        F.substring(F.min_by(F.when(asked, F.col("content")), F.when(asked, F.col("turn"))), 1, 100).alias("title"),
        F.when(n > 0, 2 * n - 1).otherwise(0).cast("long").alias("message_count"),
        F.max("turn").alias("last_turn"),
    )


