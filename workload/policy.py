"""Policy queries: policies derived from suppliers, requests from events."""

from pyspark.sql import functions as F

from lakewarden.operators import policy as P
from workload.registry import DERIVED, derive, query

DERIVED["policies"] = """
SELECT concat('policy-', s_suppkey) AS name,
  CASE WHEN s_suppkey % 3 = 0 THEN 'allow' ELSE 'deny' END AS effect,
  CASE WHEN s_suppkey % 31 = 0 THEN '*' ELSE concat('ds', (s_suppkey * 7) % 401) END AS resource_id,
  split(CASE WHEN s_suppkey % 3 = 1 THEN 'read' WHEN s_suppkey % 5 = 0 THEN 'discover' ELSE 'read,discover' END, ',') AS actions,
  split(CASE WHEN s_suppkey % 29 = 0 THEN '*' ELSE concat('user-', s_suppkey % 97, ',user-', (s_suppkey * 3) % 97) END, ',') AS subjects,
  CASE WHEN s_suppkey % 3 = 1 THEN split(concat('ssn,salary', s_nationkey % 4), ',') END AS mask_columns
FROM {supplier}"""

DERIVED["requests"] = """
SELECT event_id, concat('user-', user_id % 97) AS subject, user_id % 41 = 0 AS is_admin,
  CASE WHEN event_type = 'view' OR event_type = 'click' THEN 'read' ELSE 'discover' END AS action,
  concat('ds', (event_id * 7) % 401) AS datasource_id
FROM {events}"""

_APPLICABLE = """
pol AS (SELECT name, effect, resource_id, unnest(subjects) AS subject, actions, mask_columns FROM policies),
pol2 AS (SELECT name, effect, resource_id, subject, unnest(actions) AS action, mask_columns FROM pol)"""


def _decided(requests: str, action: str, default_deny: bool, out: str) -> str:
    """SQL: (rid, allowed, denied_by, default_denied, masks) for requests."""
    return f"""
{out}_hit AS (SELECT r.rid, p.name, p.effect, p.mask_columns FROM {requests} r JOIN pol2 p
  ON p.action = {action} AND (p.subject = r.subject OR p.subject = '*')
  AND (p.resource_id = r.datasource_id OR p.resource_id = '*')),
{out}_sum AS (SELECT rid, min(name) FILTER (WHERE effect = 'deny' AND mask_columns IS NULL) AS denied_by,
  bool_or(effect = 'allow') AS granted FROM {out}_hit GROUP BY rid),
{out}_mask AS (SELECT rid, string_agg(DISTINCT m, ',' ORDER BY m) AS masks
  FROM (SELECT rid, unnest(mask_columns) AS m FROM {out}_hit WHERE effect = 'deny' AND mask_columns IS NOT NULL) GROUP BY rid),
{out} AS (SELECT r.rid, r.is_admin,
  r.is_admin OR (s.denied_by IS NULL AND (coalesce(s.granted, false) OR NOT {default_deny})) AS allowed,
  CASE WHEN NOT r.is_admin THEN s.denied_by END AS denied_by,
  NOT r.is_admin AND s.denied_by IS NULL AND {default_deny} AND NOT coalesce(s.granted, false) AS default_denied,
  coalesce(m.masks, '') AS masks
  FROM {requests} r LEFT JOIN {out}_sum s ON r.rid = s.rid LEFT JOIN {out}_mask m ON r.rid = m.rid)"""


def decision_sql(default_deny: bool) -> str:
    return f"""WITH {_APPLICABLE}, rq AS (SELECT event_id AS rid, * FROM {{requests}}),
    touch AS (SELECT count(*) FROM {{policies}}), {_decided('rq', 'r.action', default_deny, 'd')}
    SELECT rid AS event_id, allowed, denied_by, default_denied,
      CASE WHEN allowed AND NOT is_admin THEN masks ELSE '' END AS masks FROM d"""


def _decisions(spark, sf_dir, default_deny):
    out = P.decide(derive(spark, sf_dir, "requests"), derive(spark, sf_dir, "policies"), default_deny=default_deny)
    return out.select(
        "event_id", "allowed", "denied_by", "default_denied", F.array_join("masked_columns", ",").alias("masks")
    )


@query("policy_decisions", decision_sql(False))
def policy_decisions(spark, sf_dir):
    return _decisions(spark, sf_dir, False)


@query("policy_decisions_default_deny", decision_sql(True))
def policy_decisions_default_deny(spark, sf_dir):
    return _decisions(spark, sf_dir, True)


@query(
    "policy_access_review",
    f"""WITH {_APPLICABLE}, touch AS (SELECT count(*) FROM {{policies}}),
    pr AS (SELECT DISTINCT subject, is_admin, datasource_id FROM {{requests}}),
    rq AS (SELECT row_number() OVER () AS rid, * FROM pr),
    {_decided('rq', "'read'", True, 'rd')}, {_decided('rq', "'discover'", True, 'dc')}
    SELECT rq.subject, rq.is_admin, rq.datasource_id, rd.allowed AS read, dc.allowed AS discover,
      CASE WHEN rd.allowed AND NOT rq.is_admin THEN rd.masks ELSE '' END AS masks
    FROM rq JOIN rd ON rq.rid = rd.rid JOIN dc ON rq.rid = dc.rid""",
)
def policy_access_review(spark, sf_dir):
    pairs = derive(spark, sf_dir, "requests")
    out = P.review_access(pairs, derive(spark, sf_dir, "policies"), default_deny=True)
    return out.select(
        "subject", "is_admin", "datasource_id", "read", "discover", F.array_join("masked_columns", ",").alias("masks")
    )


@query(
    "policy_visible_sources",
    f"""WITH {_APPLICABLE}, touch AS (SELECT count(*) FROM {{policies}}),
    rq AS (SELECT c_custkey AS rid, 'user-5' AS subject, false AS is_admin, concat('ds', c_custkey) AS datasource_id FROM customer),
    {_decided('rq', "'discover'", False, 'd')}
    SELECT concat('ds', rid) AS id, c_name AS name FROM d JOIN customer ON c_custkey = rid WHERE allowed""",
)
def policy_visible_sources(spark, sf_dir):
    sources = derive(spark, sf_dir, "customer").select(
        F.concat(F.lit("ds"), "c_custkey").alias("id"), F.col("c_name").alias("name")
    )
    return P.visible(sources, "id", derive(spark, sf_dir, "policies"), "user-5")


DERIVED["drafts"] = """
SELECT p_partkey, CASE WHEN p_size % 11 = 0 THEN '' ELSE p_name END AS name,
  CASE WHEN p_size % 7 = 0 THEN 'permit' WHEN p_size % 2 = 0 THEN 'deny' ELSE 'allow' END AS effect,
  CASE WHEN p_size % 13 = 0 THEN '' ELSE p_brand END AS resource_id,
  split(CASE WHEN p_partkey % 17 = 0 THEN 'write' WHEN p_partkey % 2 = 0 THEN 'read' ELSE 'read,discover' END, ',') AS actions,
  split(CASE WHEN p_partkey % 19 = 0 THEN 'a,' ELSE p_type END, ',') AS subjects,
  split(CASE WHEN p_partkey % 3 = 0 THEN 'cost' WHEN p_partkey % 23 = 0 THEN 'x,' ELSE '' END, ',') AS raw_masks
FROM {part}"""


@query(
    "policy_violations",
    """SELECT p_partkey, CASE
      WHEN length(name) NOT BETWEEN 1 AND 255 THEN 'policy name must be 1-255 characters'
      WHEN effect NOT IN ('allow', 'deny') THEN 'effect must be one of [''allow'', ''deny'']'
      WHEN list_contains(actions, 'write') THEN 'actions must be a non-empty subset of [''discover'', ''read'']'
      WHEN list_contains(subjects, '') THEN 'subjects must be a non-empty list of key ids (or [''*''])'
      WHEN resource_id = '' THEN 'resource_id must be a datasource id or ''*'''
      WHEN len(raw_masks) > 1 THEN 'conditions.columns must be a list of column names'
      WHEN raw_masks[1] <> '' AND (effect <> 'deny' OR actions <> ['read'])
        THEN 'column masking requires effect=''deny'' and actions=[''read'']' END AS violation
    FROM {drafts}""",
)
def policy_violations(spark, sf_dir):
    drafts = derive(spark, sf_dir, "drafts")
    empty = F.array().cast("array<string>")
    masks = F.when((F.size("raw_masks") == 1) & (F.col("raw_masks")[0] == ""), empty).otherwise(F.col("raw_masks"))
    out = P.policy_violations(drafts.withColumn("mask_columns", masks))
    return out.select("p_partkey", "violation")


DERIVED["logged_sql"] = """
SELECT event_id, concat('ds', user_id % 53) AS datasource_id,
  concat('SELECT ', CASE event_id % 7 WHEN 0 THEN 'SSN AS x' WHEN 1 THEN 'ssn_hash' WHEN 2 THEN 'c."Salary1"'
    WHEN 3 THEN 'count(*)' WHEN 4 THEN 'name /* salary2 */' WHEN 5 THEN 'home address' ELSE 'id' END,
    ' FROM t', user_id, ' c WHERE total > ', event_id) AS sql
FROM {events}"""

DERIVED["masks"] = """
SELECT DISTINCT concat('ds', s_suppkey % 53) AS datasource_id,
  CASE s_nationkey % 5 WHEN 0 THEN 'Ssn' WHEN 1 THEN 'salary1' WHEN 2 THEN 'salary2' WHEN 3 THEN 'home address' ELSE 'dob' END AS "column"
FROM {supplier}"""


@query(
    "policy_mask_gate",
    """SELECT q.event_id, min(lower(m."column")) AS named_mask FROM {logged_sql} q LEFT JOIN {masks} m
      ON q.datasource_id = m.datasource_id AND regexp_matches(q.sql, '(?i)\\b' || m."column" || '\\b') GROUP BY q.event_id""",
)
def policy_mask_gate(spark, sf_dir):
    masks = spark.sql(
        DERIVED["masks"].replace('"column"', "`column`"), supplier=derive(spark, sf_dir, "supplier")
    )
    return P.gate_queries(derive(spark, sf_dir, "logged_sql").select("event_id", "datasource_id", "sql"), masks).select(
        "event_id", "named_mask"
    )


@query(
    "policy_access_basis",
    "SELECT CASE WHEN is_admin THEN 'admin-bypass' ELSE 'policy' END AS basis, count(*) AS requests FROM {requests} GROUP BY 1",
)
def policy_access_basis(spark, sf_dir):
    rows = derive(spark, sf_dir, "requests").select(P.credential_basis(F.col("is_admin")).alias("basis"))
    return rows.groupBy("basis").agg(F.count(F.lit(1)).alias("requests"))


DERIVED["asked_grants"] = """
SELECT concat('user-', o_custkey) AS subject, split('read,discover', ',') AS actions,
  CASE WHEN o_orderkey % 9 = 0 THEN '*' WHEN o_orderkey % 2 = 0 THEN concat('part', o_custkey)
    ELSE concat('name', o_orderkey % 700) END AS source FROM {orders}"""
DERIVED["source_registry"] = """
SELECT concat('part', p_partkey) AS id,
  CASE WHEN p_partkey < 300 THEN concat('name', p_partkey) WHEN p_partkey < 500 THEN concat('name', p_partkey - p_partkey % 2)
    ELSE concat('other', p_partkey) END AS name FROM {part}"""
DERIVED["known_policies"] = "SELECT concat('allow-user-', c_custkey, '-name', c_custkey) AS name FROM {customer}"

_RESOLVED = """
byname AS (SELECT name AS n, count(*) AS c, min(id) AS nid FROM {source_registry} GROUP BY name),
res AS (SELECT a.subject, a.source, CASE WHEN a.source = '*' THEN '*' WHEN r.id IS NOT NULL THEN r.id WHEN b.c = 1 THEN b.nid END AS resource_id,
  CASE WHEN a.source = '*' THEN 'all sources' WHEN r.id IS NOT NULL THEN r.name WHEN b.c = 1 THEN a.source END AS label,
  CASE WHEN a.source = '*' OR r.id IS NOT NULL OR b.c = 1 THEN NULL
    WHEN b.c > 1 THEN concat(a.source, ' (ambiguous: ', b.c, ' sources share this name — use an id)') ELSE a.source END AS problem
  FROM {asked_grants} a LEFT JOIN {source_registry} r ON a.source = r.id LEFT JOIN byname b ON a.source = b.n)"""


@query(
    "policy_grants",
    f"""WITH {_RESOLVED}, named AS (SELECT concat('allow-', subject, '-', CASE WHEN resource_id = '*' THEN 'all' ELSE label END) AS name,
      resource_id, subject, concat('Grant ', subject, ' read+discover on ', label) AS description FROM res WHERE problem IS NULL)
    SELECT name, min(resource_id) AS resource_id, any_value(subject) AS subject, any_value(description) AS description
    FROM named WHERE name NOT IN (SELECT name FROM {{known_policies}}) GROUP BY name""",
)
def policy_grants(spark, sf_dir):
    made, _ = P.grant_policies(*(derive(spark, sf_dir, n) for n in ("asked_grants", "source_registry", "known_policies")))
    return made.select("name", "resource_id", F.col("subjects")[0].alias("subject"), "description")


@query(
    "policy_grant_problems",
    f"WITH {_RESOLVED} SELECT problem, count(*) AS asked FROM res WHERE problem IS NOT NULL GROUP BY problem",
)
def policy_grant_problems(spark, sf_dir):
    _, refused = P.grant_policies(*(derive(spark, sf_dir, n) for n in ("asked_grants", "source_registry", "known_policies")))
    return refused.groupBy("problem").agg(F.count(F.lit(1)).alias("asked"))


DERIVED["grants"] = """
SELECT CASE o_orderkey % 3 WHEN 0 THEN 'oracle' WHEN 1 THEN 'sqlserver' ELSE 'postgres' END AS engine,
  CASE WHEN o_orderkey % 5 = 0 THEN concat('role', o_custkey % 40) WHEN o_orderkey % 997 = 3 THEN 'PUBLIC' ELSE concat('login', o_custkey) END AS grantee,
  CASE WHEN o_orderkey % 2 = 0 THEN 'system' ELSE 'object' END AS kind,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'INSERT' WHEN '2-HIGH' THEN 'SELECT' WHEN '3-MEDIUM' THEN 'READ'
    WHEN '5-LOW' THEN 'CREATE SESSION' ELSE 'CONNECT' END AS privilege
FROM {orders}"""
DERIVED["memberships"] = """
SELECT CASE c_custkey % 3 WHEN 0 THEN 'oracle' WHEN 1 THEN 'sqlserver' ELSE 'postgres' END AS engine,
  concat('login', c_custkey) AS login,
  CASE WHEN c_custkey % 11 = 0 THEN 'db_owner' WHEN c_custkey % 4 = 0 THEN NULL ELSE concat('role', c_nationkey) END AS role
FROM {customer}"""


@query(
    "grants_who_can_write",
    """WITH unsafe AS (SELECT DISTINCT engine, grantee, privilege FROM {grants} WHERE CASE engine
        WHEN 'oracle' THEN NOT (CASE kind WHEN 'system' THEN privilege IN ('CREATE SESSION') ELSE privilege IN ('SELECT', 'READ') END)
        WHEN 'sqlserver' THEN NOT (kind = 'system' AND privilege IN ('CONNECT', 'SELECT'))
        ELSE privilege IN ('INSERT', 'UPDATE', 'DELETE', 'TRUNCATE', 'SUPERUSER') END),
      held AS (SELECT m.engine, m.login, u.privilege FROM {memberships} m JOIN unsafe u ON m.engine = u.engine
        AND (u.grantee = m.role OR u.grantee = m.login OR u.grantee = 'PUBLIC')
        UNION SELECT engine, login, 'member of db_owner' FROM {memberships} WHERE engine = 'sqlserver' AND role = 'db_owner')
      SELECT engine, login, string_agg(privilege, ',' ORDER BY privilege) AS privileges FROM held GROUP BY engine, login""",
)
def grants_who_can_write(spark, sf_dir):
    out = P.unsafe_grants(derive(spark, sf_dir, "grants"), derive(spark, sf_dir, "memberships"))
    return out.withColumn("privileges", F.array_join("privileges", ","))
