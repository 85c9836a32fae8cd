"""Entity resolution between two name lists derived from parts."""

from pyspark.sql import functions as F

from lakewarden.operators import resolve as R
from lakewarden.session import use_all_cores
from workload.registry import DERIVED, derive, query

_PARTS = "(SELECT p_partkey AS k, p_name AS w, lower(p_type) AS t, concat('lot', CAST(floor(p_partkey / 3) AS BIGINT)) AS lot FROM {part}) x"
DERIVED["vendors_left"] = f"""
SELECT k, CASE k % 7 WHEN 0 THEN concat(w, ' ', t, ' ', lot, ' LLC') WHEN 1 THEN concat(lot, ' ', w, ' Group')
  WHEN 2 THEN concat(t, ' ', lot, ' ', upper(w), ', Inc.') WHEN 3 THEN concat('  ', w, ' ', lot, ' Holdings') WHEN 4 THEN concat(w, ' ', t, ' ', lot, ' north')
  WHEN 5 THEN concat('x', lot, ' ', w, ' east') ELSE '[REDACTED:email]' END AS name FROM {_PARTS}"""
DERIVED["vendors_right"] = f"""
SELECT k, CASE k % 5 WHEN 0 THEN concat(upper(w), ' ', t, '-', lot, ' corp.') WHEN 1 THEN concat(lot, '/', w)
  WHEN 2 THEN concat(w, ' ', lot, ' Partners') WHEN 3 THEN concat(lot, ' ', t, ' ', w, ' south') ELSE concat('Co ', k) END AS name FROM {_PARTS}"""

_LEGAL = R.LEGAL_FORMS.replace("(?U)", "")
_PUNCT = R.PUNCTUATION.replace("'", "''")
_WORDS = ", ".join(f"'{w}'" for w in R.DESCRIPTIVE)


def _usable(side: str, source: str) -> str:
    return f"""{side}v AS (SELECT s AS spelling, trim(regexp_replace(regexp_replace(regexp_replace(upper(s), '{_LEGAL}', '', 'g'),
        '{_PUNCT}', ' ', 'g'), '\\s+', ' ', 'g')) AS norm, min(k) AS first_position
      FROM (SELECT k, trim(name) AS s FROM {source}) WHERE s <> '' AND NOT contains(s, '[REDACTED') GROUP BY s),
    {side}u AS (SELECT * FROM {side}v WHERE length(norm) >= 3 AND regexp_matches(norm, '[A-Z]')),
    {side} AS (SELECT norm, arg_min(spelling, (first_position, spelling)) AS value, count(*) AS n_variants,
      list_sort(list_distinct([w FOR w IN string_split(norm, ' ') IF length(w) >= 4])) AS sig,
      array_to_string(list_sort(string_split(norm, ' ')), ' ') AS bag,
      array_to_string([w FOR w IN string_split(norm, ' ') IF w NOT IN ({_WORDS})], ' ') AS core FROM {side}u GROUP BY norm)"""


_MATCHED = f"""WITH {_usable('l', '{vendors_left}')}, {_usable('r', '{vendors_right}')},
  rb AS (SELECT bag, min(norm) AS m FROM r GROUP BY bag), rc AS (SELECT core, min(norm) AS m FROM r WHERE length(core) >= 3 GROUP BY core),
  direct AS (SELECT l.norm, coalesce(e.norm, rb.m, rc.m) AS rn, CASE WHEN e.norm IS NOT NULL THEN 0 WHEN rb.m IS NOT NULL THEN 1
      WHEN rc.m IS NOT NULL THEN 2 END AS tier FROM l LEFT JOIN r e ON e.norm = l.norm LEFT JOIN rb ON rb.bag = l.bag
      LEFT JOIN rc ON rc.core = l.core AND length(l.core) >= 3),
  lt AS (SELECT l.norm, len(l.sig) AS n, unnest(l.sig) AS w FROM l JOIN direct d ON d.norm = l.norm WHERE d.rn IS NULL),
  rt AS (SELECT norm, len(sig) AS n, unnest(sig) AS w FROM r),
  o AS (SELECT lt.norm, rt.norm AS rn, count(*) AS shared, least(any_value(lt.n), any_value(rt.n)) AS m FROM lt JOIN rt ON lt.w = rt.w GROUP BY lt.norm, rt.norm),
  best AS (SELECT norm, rn, shared, row_number() OVER (PARTITION BY norm ORDER BY shared DESC, rn) AS place FROM o WHERE shared / m > 0.6),
  m AS (SELECT norm, rn, tier, 0 AS shared FROM direct WHERE rn IS NOT NULL
    UNION ALL SELECT norm, rn, 3, shared FROM best WHERE place = 1 AND shared >= 2),
  matched AS (SELECT m.tier, m.norm AS normalized, m.rn AS right_normalized, l.value AS left_value, l.n_variants AS left_variants,
    r.value AS right_value, r.n_variants AS right_variants,
    CASE tier WHEN 0 THEN 'exact' WHEN 1 THEN 'token_set' WHEN 2 THEN 'core' ELSE 'token_overlap' END AS match_type,
    CASE tier WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence,
    CASE tier WHEN 0 THEN 'identical after normalization' WHEN 1 THEN 'same words, different order'
      WHEN 2 THEN concat('same name ignoring descriptive words (', array_to_string(list_sort(list_distinct(
        [w FOR w IN list_concat(string_split(m.norm, ' '), string_split(m.rn, ' ')) IF w IN ({_WORDS})])), ', '), ')')
      ELSE concat(m.shared, ' significant tokens shared') END AS rationale
    FROM m JOIN l ON l.norm = m.norm JOIN r ON r.norm = m.rn)"""


def _sides(spark, sf_dir):
    named = (use_all_cores(derive(spark, sf_dir, n)) for n in ("vendors_left", "vendors_right"))
    return [R.distinct_entities(R.entity_variants(d, "name", position="k")) for d in named]


@query("entity_matches", f"{_MATCHED} SELECT * FROM matched")
def entity_matches(spark, sf_dir):
    return R.match_entities(*_sides(spark, sf_dir))


@query(
    "entity_stats",
    f"""{_MATCHED} SELECT count(*) AS matches, count(*) FILTER (WHERE confidence = 'high') AS high_confidence,
    count(*) FILTER (WHERE confidence = 'medium') AS medium_confidence, count(*) FILTER (WHERE confidence = 'low') AS low_confidence,
    (SELECT count(*) FROM l) AS left_distinct, (SELECT count(*) FROM r) AS right_distinct FROM matched""",
)
def entity_stats(spark, sf_dir):
    return R.match_with_stats(*_sides(spark, sf_dir))


@query("entity_variants", f"WITH {_usable('l', '{vendors_left}')} SELECT norm, spelling, first_position FROM lu")
def entity_variants(spark, sf_dir):
    return R.entity_variants(derive(spark, sf_dir, "vendors_left"), "name", position="k")


@query(
    "entity_customer_supplier",
    f"""WITH {_usable('l', '(SELECT c_custkey AS k, c_name AS name FROM customer)')},
    {_usable('r', "(SELECT s_suppkey AS k, replace(s_name, 'Supplier', 'customer') AS name FROM supplier)")}
    SELECT l.norm AS normalized, l.value AS left_value, r.value AS right_value FROM l JOIN r ON l.norm = r.norm""",
)
def entity_customer_supplier(spark, sf_dir):
    left = derive(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_custkey").alias("k"))
    right = derive(spark, sf_dir, "supplier").select(
        F.replace("s_name", F.lit("Supplier"), F.lit("customer")).alias("name"), F.col("s_suppkey").alias("k")
    )
    sides = [R.distinct_entities(R.entity_variants(d, "name", position="k")) for d in (left, right)]
    out = R.match_entities(*sides)
    return out.filter("tier = 0").select("normalized", "left_value", "right_value")
