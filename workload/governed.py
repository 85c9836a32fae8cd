"""Arbitrary SQL over governed views: policy, masks, redaction in one plan."""

from lakewarden.plans.governed import GovernedSession, Identity
from workload.pii import redaction_ctes
from workload.registry import query, table

_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "documents"]
_POLICIES = """
SELECT 'mask-balances' AS name, 'deny' AS effect, '*' AS resource_id, array('read') AS actions, array('analyst') AS subjects,
  array('c_acctbal', 'S_AcctBal', 'l_tax') AS mask_columns
UNION ALL SELECT 'allow-analyst', 'allow', 'warehouse', array('read', 'discover'), array('analyst'), NULL"""


def governed(spark, sf_dir, sql, subject="analyst", **options):
    session = GovernedSession(spark, spark.sql(_POLICIES), default_deny=True)
    session.register(
        "warehouse", {t: (lambda s, t=t: table(s, sf_dir, t)) for t in _TABLES}
    )
    return session.query("warehouse", sql, Identity(subject), **options)


def _same(name: str, sql: str):
    """A query whose governed answer equals the plain one."""

    @query(name, sql)
    def run(spark, sf_dir):
        return governed(spark, sf_dir, sql).numbers()

    return run


_same(
    "governed_filter_project",
    "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem WHERE l_discount >= 0.05 AND l_quantity < 24",
)
_same(
    "governed_join",
    """SELECT n_name, c_mktsegment, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders
    JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA' GROUP BY n_name, c_mktsegment""",
)
_same(
    "governed_semi_anti_join",
    """SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')
    AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')""",
)
_same(
    "governed_agg",
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue,
    count(DISTINCT l_partkey) AS parts, count(*) AS lines FROM lineitem GROUP BY l_returnflag, l_linestatus""",
)
_same(
    "governed_rollup",
    """SELECT o_orderstatus, o_orderpriority, CAST(grouping(o_orderpriority) AS INT) AS is_total, count(*) AS orders FROM orders
    GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())""",
)
_same(
    "governed_window",
    """SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INT) AS place,
    round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running FROM orders""",
)
_same(
    "governed_topk",
    "SELECT p_partkey, p_name, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 50",
)
_same(
    "governed_setops",
    """SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier
    UNION (SELECT n_nationkey + 1000 FROM nation EXCEPT SELECT s_nationkey + 1000 FROM supplier)""",
)


@query("governed_masked", "SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer")
def governed_masked(spark, sf_dir):
    return governed(spark, sf_dir, "SELECT * FROM customer").numbers()


@query(
    "governed_documents",
    f"""WITH {redaction_ctes('documents', 'doc_id, source', 'text')}
    SELECT doc_id, source, t AS text FROM r5""",
)
def governed_documents(spark, sf_dir):
    return governed(spark, sf_dir, "SELECT doc_id, source, text FROM documents").numbers()


@query(
    "governed_view_mode",
    f"""WITH {redaction_ctes('documents', 'lang, doc_id', 'text')} SELECT lang, count(*) AS documents FROM r5
    WHERE t LIKE '%[REDACTED:%' GROUP BY lang""",
)
def governed_view_mode(spark, sf_dir):
    sql = "SELECT lang, count(*) AS documents FROM documents WHERE text LIKE '%[REDACTED:%' GROUP BY lang"
    return governed(spark, sf_dir, sql, mode="view").numbers()


