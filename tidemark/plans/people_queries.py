"""Queries of users, roles, permissions, lists and table changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import access, filters, index
from tidemark.plans import standins as st

QUERIES, SQL = {}, {}
P = f"WITH {st.USERS_SQL}"
ALL_CODES = (
    "granted AS (SELECT DISTINCT user_id, code FROM user_roles JOIN role_permissions USING (role_id) JOIN permissions p ON p.id = permission_id"
    " UNION SELECT u.id, code FROM users u CROSS JOIN permissions WHERE is_superadmin)"
)


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


PRIMARY = (
    "primary_role AS (SELECT user_id, name AS role FROM (SELECT * FROM user_roles"
    " QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, role_id DESC) = 1) r JOIN roles ON roles.id = role_id)"
)


@query(
    f"""{P}, {PRIMARY} SELECT u.id, u.name, coalesce(n_name, '-') AS department,
    coalesce(p.role, CASE WHEN is_superadmin THEN 'admin' ELSE 'user' END) AS role
    FROM users u LEFT JOIN nation ON n_nationkey = department_id LEFT JOIN primary_role p ON p.user_id = u.id"""
)
def user_directory(spark, sf_dir):
    return access.user_directory(st.users(spark, sf_dir), st.departments(spark, sf_dir), st.user_roles(spark, sf_dir), st.roles(spark, sf_dir))


@query(f"{P}, {PRIMARY} SELECT * FROM primary_role")
def primary_role(spark, sf_dir):
    return access.primary_role(st.user_roles(spark, sf_dir), st.roles(spark, sf_dir))


def _granted(spark, sf_dir):
    return access.effective_permissions(
        st.users(spark, sf_dir), st.user_roles(spark, sf_dir), st.role_permissions(spark, sf_dir), st.permissions(spark, sf_dir)
    )


@query(f"{P}, {ALL_CODES} SELECT user_id, code FROM granted")
def effective_permissions(spark, sf_dir):
    return _granted(spark, sf_dir)


@query(
    f"""{P}, {ALL_CODES} SELECT u.id AS user_id, is_superadmin OR (u.id % 5 > 0 AND count(DISTINCT code) FILTER (code IN ('a.f.1', 'n.o.2')) = 2) AS has_all,
    is_superadmin OR count(DISTINCT code) FILTER (code IN ('a.f.1', 'n.o.2')) > 0 AS has_any
    FROM users u LEFT JOIN granted g ON g.user_id = u.id GROUP BY u.id, is_superadmin"""
)
def check_permissions(spark, sf_dir):
    """Two codes are asked for, of every fifth user a third one that no table lists."""
    users, two = st.users(spark, sf_dir), (F.lit("a.f.1"), F.lit("n.o.2"))
    codes = F.when(F.col("id") % 5 == 0, F.array(*two, F.lit("not.listed"))).otherwise(F.array(*two))
    return access.check_permissions(_granted(spark, sf_dir), users.select(F.col("id").alias("user_id"), codes.alias("codes")), users)


@query(f"{P}, {ALL_CODES} SELECT id FROM users WHERE is_superadmin OR id IN (SELECT user_id FROM granted WHERE code = 'r.f.3')")
def has_permission(spark, sf_dir):
    return access.has_permission(st.users(spark, sf_dir), _granted(spark, sf_dir), "r.f.3").select("id")


@query(
    f"""{P} SELECT r.id AS role_id, p.id AS permission_id FROM (SELECT DISTINCT ['SUPER_ADMIN', 'ORG_ADMIN', 'MISSING'][l_linenumber % 3 + 1] AS role,
    lower(l_returnflag) || '.' || lower(l_linestatus) || '.' || (l_linenumber + l_orderkey % 3) AS code FROM lineitem) d
    JOIN roles r ON r.name = d.role JOIN permissions p USING (code)"""
)
def role_matrix(spark, sf_dir):
    """Default codes from line items; a role and some codes do not exist."""
    role = F.element_at(F.array(F.lit("SUPER_ADMIN"), F.lit("ORG_ADMIN"), F.lit("MISSING")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    code = F.concat_ws(".", F.lower("l_returnflag"), F.lower("l_linestatus"), (F.col("l_linenumber") + F.col("l_orderkey") % 3).cast("string"))
    lines = st.table(spark, sf_dir, "lineitem").select(role.alias("role"), code.alias("code"))
    defaults = lines.groupBy("role").agg(F.collect_set("code").alias("codes"))
    return access.role_matrix(defaults, st.roles(spark, sf_dir), st.permissions(spark, sf_dir))


@query(f"{P} SELECT r.id, r.name, count(user_id) AS users FROM roles r LEFT JOIN user_roles ON role_id = r.id GROUP BY ALL")
def users_per_role(spark, sf_dir):
    return access.users_per_role(st.roles(spark, sf_dir), st.user_roles(spark, sf_dir))


@query(
    f"""{P} SELECT r.id, r.name, coalesce(string_agg(code, ',' ORDER BY code), '') AS codes
    FROM roles r LEFT JOIN role_permissions ON role_id = r.id LEFT JOIN permissions p ON p.id = permission_id GROUP BY ALL"""
)
def permissions_per_role(spark, sf_dir):
    rows = access.permissions_per_role(st.roles(spark, sf_dir), st.role_permissions(spark, sf_dir), st.permissions(spark, sf_dir))
    return rows.withColumn("codes", F.array_join("codes", ","))


@query(f"{P} SELECT DISTINCT string_split(code, '.')[1] AS category FROM permissions")
def permission_categories(spark, sf_dir):
    return access.permission_categories(st.permissions(spark, sf_dir))


@query(
    f"""{P} SELECT u.id, coalesce(string_agg(r.name, ',' ORDER BY r.name), '') AS roles,
    u.is_superadmin OR coalesce(bool_or(r.name IN ('SUPER_ADMIN', 'ORG_ADMIN')), false) AS is_admin
    FROM users u LEFT JOIN user_roles x ON x.user_id = u.id LEFT JOIN roles r ON r.id = role_id GROUP BY u.id, u.is_superadmin"""
)
def user_roles_summary(spark, sf_dir):
    rows = access.user_roles_summary(st.users(spark, sf_dir), st.user_roles(spark, sf_dir), st.roles(spark, sf_dir))
    return rows.withColumn("roles", F.array_join("roles", ","))


@query(
    """SELECT o_orderkey AS id, coalesce(string_agg(DISTINCT t, ',' ORDER BY t), '') AS tags FROM orders LEFT JOIN
    (SELECT l_orderkey, unnest([l_returnflag, l_linestatus]) AS t FROM lineitem WHERE l_quantity > 25) ON l_orderkey = o_orderkey GROUP BY 1"""
)
def with_tags(spark, sf_dir):
    """Flags of large line items as tags of orders."""
    lines = st.table(spark, sf_dir, "lineitem").filter("l_quantity > 25")
    tags = lines.select(F.col("l_orderkey").alias("item_id"), F.explode(F.array("l_returnflag", "l_linestatus")).alias("tag"))
    orders = st.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    return access.with_tags(orders, tags).withColumn("tags", F.array_join("tags", ","))


@query(
    """SELECT conv_id AS conversation_id, conv_id % 10 AS user_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations"""
)
def owned_messages(spark, sf_dir):
    messages = st.messages(spark, sf_dir)
    owners = messages.select(F.col("conversation_id").alias("id")).distinct().withColumn("user_id", F.col("id") % 10)
    rows = access.owned_messages(messages, owners)
    return rows.select("conversation_id", "user_id", "turn", F.col("place").cast("long").alias("place"))


@query(
    """SELECT conv_id AS conversation_id, substr(min_by(text, turn) FILTER (role = 'user'), 1, 100) AS title,
    greatest(2 * count(*) FILTER (role = 'user') - 1, 0) AS message_count, max(turn) AS last_turn FROM conversations GROUP BY 1"""
)
def conversation_rollup(spark, sf_dir):
    return access.conversation_rollup(st.messages(spark, sf_dir))


@query(
    f"""WITH {st.JOBS_SQL} SELECT id, organization_id, row_number() OVER (PARTITION BY organization_id ORDER BY created_at DESC, id DESC) AS rank
    FROM jobs QUALIFY rank <= 100"""
)
def newest_per_tenant(spark, sf_dir):
    rows = access.newest_per_tenant(st.jobs(spark, sf_dir), "created_at", "id")
    return rows.select("id", "organization_id", F.col("rank").cast("long").alias("rank"))


@query(
    f"""WITH {st.JOBS_SQL} SELECT id, organization_id, row_number() OVER (PARTITION BY organization_id ORDER BY created_at, id) AS place
    FROM jobs WHERE status = 'PENDING' AND retry_count < max_retries"""
)
def pending_backlog(spark, sf_dir):
    rows = access.pending_backlog(st.jobs(spark, sf_dir))
    return rows.select("id", "organization_id", F.col("place").cast("long").alias("place"))


@query(f"WITH {st.AUDIT_SQL} SELECT id, event_code FROM audit ORDER BY created_at DESC, id DESC LIMIT 200")
def audit_feed(spark, sf_dir):
    return access.audit_feed(st.audit(spark, sf_dir), None, 500).select("id", "event_code")


@query(f"WITH {st.AUDIT_SQL} SELECT id, event_code FROM audit WHERE organization_id = 3 ORDER BY created_at DESC, id DESC LIMIT 50")
def audit_feed_of_tenant(spark, sf_dir):
    return access.audit_feed(st.audit(spark, sf_dir), 3).select("id", "event_code")


@query(
    f"""WITH {st.AUDIT_SQL} SELECT id FROM audit WHERE contains(actor_name, 'login') OR coalesce(contains(resource_name, 'login'), false) OR contains(event_code, 'LOGIN')"""
)
def search_audit(spark, sf_dir):
    return filters.search_audit(st.audit(spark, sf_dir), "login").select("id")


@query(f"{P} SELECT id FROM users WHERE contains(name, '42') OR contains(email, '42') OR contains(username, '42')")
def search_users(spark, sf_dir):
    return filters.search_users(st.users(spark, sf_dir), "42").select("id")


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus <> 'P' AND o_custkey % 5 = 2")
def live_rows(spark, sf_dir):
    """Orders of a tenant by customer; those in progress count as deleted."""
    rows = st.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 5).alias("organization_id"),
        F.when(F.col("o_orderstatus") == "P", F.col("o_orderdate")).alias("deleted_at"),
    )
    return filters.live_rows(rows, 2).select("id")


@query(f"WITH {st.JOBS_SQL} SELECT id FROM jobs WHERE status = 'FAILED'")
def status_filter(spark, sf_dir):
    return filters.status_filter(st.jobs(spark, sf_dir), "FAILED").select("id")


@query(
    f"""{P} SELECT event_id AS id FROM events e JOIN users u ON u.id = e.user_id WHERE event_type <> 'error' AND ts + INTERVAL 48 HOUR > TIMESTAMP '2024-01-20 00:00:00'
    AND is_active AND (locked_until IS NULL OR locked_until <= TIMESTAMP '2024-01-20 00:00:00')"""
)
def live_sessions(spark, sf_dir):
    """Events as sessions of 48 hours; errors count as revoked."""
    sessions = st.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), "user_id", (F.col("event_type") == "error").alias("is_revoked"), (F.col("ts") + F.expr("INTERVAL 48 HOURS")).alias("expires_at")
    )
    return filters.live_sessions(sessions, st.users(spark, sf_dir), F.to_timestamp(F.lit("2024-01-20 00:00:00"))).select("id")


@query(
    f"""{P} SELECT u.id AS user_id, s_suppkey AS resource_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey
    JOIN users u ON u.id = o_custkey JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey % 5 = u.organization_id
    WHERE u.role IN ('manager', 'admin') OR s_nationkey = u.department_id OR s_suppkey % 3 = 0"""
)
def department_access(spark, sf_dir):
    """Suppliers as resources, of which every third belongs to no department; line items as
    requests of customers for suppliers."""
    orders = st.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("user_id"))
    requests = st.table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("resource_id")).join(orders, "l_orderkey")
    resources = st.table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"), (F.col("s_nationkey") % 5).alias("organization_id"),
        F.when(F.col("s_suppkey") % 3 != 0, F.col("s_nationkey")).alias("department_id"),
    )
    return filters.department_access(requests, resources, st.users(spark, sf_dir))


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey % 4 = 0 OR c_nationkey = 7")
def visible_roles(spark, sf_dir):
    """Customers as roles; every fourth belongs to the system."""
    org = F.when(F.col("c_custkey") % 4 != 0, F.col("c_nationkey"))
    rows = st.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), org.alias("organization_id"))
    return filters.visible_roles(rows, 7).select("id")


@query(
    """SELECT key, value FROM (SELECT c_name AS key, -1::BIGINT AS value FROM customer WHERE c_custkey % 2 = 0
    UNION ALL SELECT c_name, min(o_orderkey) FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_custkey % 2 = 1 GROUP BY 1)"""
)
def insert_if_absent(spark, sf_dir):
    """Even customers are in the table; orders bring the names of all."""
    customers = st.table(spark, sf_dir, "customer")
    table = customers.filter("c_custkey % 2 = 0").select(F.col("c_name").alias("key"), F.lit(-1).cast("long").alias("value"))
    incoming = st.table(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_name").alias("key"), F.col("o_orderkey").alias("value")
    )
    return index.insert_if_absent(table, incoming, ["key"], ["value"])


@query(
    """SELECT o_custkey AS key, o_orderkey AS value, o_orderdate::VARCHAR AS stamp FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1"""
)
def upsert_by_key(spark, sf_dir):
    """Orders of one half of the keys, then the other, as settings of customers."""
    rows = st.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("value"), F.col("o_orderdate").alias("stamp"))
    newest = index.upsert_by_key(rows.filter("value % 2 = 0"), rows.filter("value % 2 = 1"), ["key"], "stamp", "value")
    return newest.withColumn("stamp", F.col("stamp").cast("string"))


@query(
    f"""{P} SELECT user_id, role_id FROM user_roles WHERE user_id % 3 <> 0
    UNION ALL SELECT id, (id % 5 + 1)::INTEGER FROM users WHERE id % 3 = 0"""
)
def replace_grants(spark, sf_dir):
    users = st.users(spark, sf_dir).filter("id % 3 = 0").select(F.col("id").alias("user_id"))
    new = users.withColumn("role_id", (F.col("user_id") % 5 + 1).cast("int"))
    return index.replace_grants(st.user_roles(spark, sf_dir).select("user_id", "role_id"), users, new, "user_id")
