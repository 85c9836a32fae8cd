"""Metric catalog and questions derived from parts and orders."""

from pyspark.sql import functions as F

from lakewarden.operators import metrics as M
from lakewarden.operators import questions as N
from lakewarden.session import use_all_cores
from workload.registry import DERIVED, derive, query

# One draft metric per part; templates and parameters are flawed on purpose here and there.
DERIVED["metric_drafts"] = """
SELECT p_partkey AS ord, concat(replace(p_name, ' ', '_'), '_', p_partkey) AS name, concat('mail bob@example.com about ', p_type) AS description,
  CASE WHEN p_size % 3 = 0 THEN 'human' ELSE 'proposed' END AS source,
  CASE WHEN p_size % 11 = 0 THEN '{{"sql": "SELECT 1"}}' WHEN p_size % 7 = 0 THEN '{{"sql": "a = {{kind}} LIMIT {{n}} {{ghost}}"}}'
    ELSE '{{"sql": "SELECT * FROM part WHERE p_type = {{kind}} LIMIT {{n}}"}}' END AS template,
  CASE WHEN p_size % 5 = 0 THEN 'list' ELSE 'string' END AS kind_type,
  CASE WHEN p_size % 13 = 0 THEN '"bad''quote"' WHEN p_size % 4 = 0 THEN '"x--y"' ELSE '"SMALL"' END AS kind_default,
  CASE WHEN p_size % 17 = 0 THEN '1e999' WHEN p_size % 2 = 0 THEN '10' ELSE '"10"' END AS n_default, p_size
FROM {part}"""


def _with_params(df):
    def spec(name, kind, default):
        return F.struct(
            F.lit(name).alias("name"), F.col(kind).alias("type"), F.col(default).alias("default"), F.lit(True).alias("has_default")
        )

    rows = df.withColumn("n_type", F.lit("number")).withColumn("datasource_id", F.lit("warehouse"))
    return rows.withColumn("params", F.array(spec("kind", "kind_type", "kind_default"), spec("n", "n_type", "n_default")))


_NAME_ERROR = "(allowed: letters, digits, space, _ . @ -, no ''--'', max 200)"
_DEFINITION_ERROR = f"""CASE WHEN kind_type = 'list' THEN 'parameter ''kind'' needs a type of ''string'' or ''number'''
  WHEN kind_default <> '"SMALL"' THEN 'parameter ''kind'' contains disallowed characters {_NAME_ERROR}'
  WHEN n_default <> '10' THEN 'parameter ''n'' must be a finite number'
  WHEN contains(template, 'ghost') THEN 'template references undeclared parameters: [''ghost'']'
  WHEN NOT contains(template, 'kind') THEN 'declared parameters never used in the template: [''kind'', ''n'']' END"""


@query("metric_definition_errors", f"SELECT ord, {_DEFINITION_ERROR} AS error FROM {{metric_drafts}}")
def metric_definition_errors(spark, sf_dir):
    return M.definition_errors(_with_params(derive(spark, sf_dir, "metric_drafts"))).select("ord", "error")


@query(
    "metric_placeholders",
    """SELECT ord, CASE WHEN contains(template, 'ghost') THEN 'ghost,kind,n' WHEN contains(template, 'kind') THEN 'kind,n' ELSE '' END AS names
    FROM {metric_drafts}""",
)
def metric_placeholders(spark, sf_dir):
    return derive(spark, sf_dir, "metric_drafts").select("ord", F.array_join(F.array_sort(M.placeholders("template")), ",").alias("names"))


DERIVED["taken_names"] = "SELECT concat('blue_bolt_', c_custkey) AS name FROM {customer}"


@query(
    "metric_additions",
    f"""SELECT name, 'mail [REDACTED:email] about ' || p_type AS description, CASE WHEN source = 'human' THEN 'approved' ELSE 'candidate' END AS status
    FROM {{metric_drafts}} JOIN part ON p_partkey = ord WHERE ({_DEFINITION_ERROR}) IS NULL AND name NOT IN (SELECT name FROM {{taken_names}})""",
)
def metric_additions(spark, sf_dir):
    drafts = _with_params(derive(spark, sf_dir, "metric_drafts"))
    added, _ = M.add_metrics(derive(spark, sf_dir, "taken_names"), drafts, F.current_timestamp())
    return added.select("name", "description", "status")


# One call per order of a two-parameter metric, some of them out of bounds.
DERIVED["metric_calls"] = """
SELECT o_orderkey, CASE WHEN o_orderkey % 29 = 0 THEN 'candidate' ELSE 'approved' END AS status,
  CASE o_orderkey % 6 WHEN 0 THEN '"it''s"' WHEN 1 THEN concat('"', o_orderpriority, '"') WHEN 2 THEN '7' WHEN 3 THEN '"a b_c.d@e-f"' ELSE '"F"' END AS kind,
  CASE o_orderkey % 5 WHEN 0 THEN '"5"' WHEN 1 THEN CAST(o_custkey AS STRING) WHEN 2 THEN concat(o_custkey, '.5') WHEN 3 THEN '' ELSE 'true' END AS n,
  o_orderkey % 31 = 0 AS extra FROM {orders}"""


@query(
    "metric_requests",
    f"""WITH v AS (SELECT *, CASE WHEN status <> 'approved' THEN 'metric is not approved (status: candidate)'
        WHEN extra THEN 'unknown parameters: [''extra'']'
        WHEN kind = '"it''s"' THEN 'parameter ''kind'' contains disallowed characters {_NAME_ERROR}'
        WHEN n = 'true' OR n = '"5"' THEN 'parameter ''n'' must be a finite number' END AS error FROM {{metric_calls}})
    SELECT o_orderkey, error, CASE WHEN error IS NULL THEN concat('{{{{"sql": "WHERE a = ''', replace(kind, '"', ''), ''' LIMIT ',
      CASE WHEN n = '' THEN '10' ELSE n END, '"}}}}') END AS request FROM v""",
)
def metric_requests(spark, sf_dir):
    calls = use_all_cores(derive(spark, sf_dir, "metric_calls"))
    params = f"""from_json('[{{"name":"kind","type":"string","has_default":false}},{{"name":"n","type":"number","default":"10","has_default":true}}]',
      '{M.PARAMS_TYPE}')"""
    bound = F.map_filter(
        F.create_map(F.lit("kind"), F.col("kind"), F.lit("n"), F.col("n"), F.lit("extra"), F.when(F.col("extra"), "1").otherwise("")),
        lambda k, v: v != "",
    )
    calls = calls.select("o_orderkey", "status", F.lit("""{"sql": "WHERE a = '{kind}' LIMIT {n}"}""").alias("template"),
                         F.expr(params).alias("params"), bound.alias("bound"))
    return M.render_requests(calls).select("o_orderkey", "error", "request")


# Approved metrics by product name and type; questions by part and order priority.
DERIVED["catalog"] = """
SELECT DISTINCT concat(replace(p_name, ' ', '_'), '_by_', lower(p_type)) AS name, concat('Total ', p_name, ' sales of ', lower(p_type), ' parts') AS description,
  concat(p_name, p_type) AS id, CASE WHEN p_type = 'PROMO' THEN 'candidate' ELSE 'approved' END AS status FROM {part}"""
DERIVED["questions"] = """
SELECT p_partkey AS question_id, concat(CASE p_partkey % 4 WHEN 0 THEN 'How many ' WHEN 1 THEN 'Show me the ' WHEN 2 THEN 'weather of ' ELSE 'list ' END, CASE WHEN p_partkey % 4 = 2 THEN 'tomorrow'
  ELSE concat(p_name, 's') END, CASE WHEN p_partkey % 3 = 0 THEN concat(' by ', p_type) WHEN p_partkey % 3 = 1 THEN concat(' for ''', p_brand, ''' above ', p_size) ELSE concat(' in ''', p_type, ' parts'' over ', p_size, ' city=Boston') END, '?') AS question
FROM {part}"""


def _tokens(c: str) -> str:
    stop = ", ".join(f"'{w}'" for w in N.STOPWORDS)
    words = f"[w FOR w IN regexp_extract_all(lower(replace(replace({c}, '_', ' '), '-', ' ')), '[a-z0-9]+') IF length(w) >= 2 AND w NOT IN ({stop})]"
    fold = (
        "CASE WHEN suffix(w, 'ies') AND length(w) > 4 THEN substr(w, 1, length(w) - 3) || 'y' "
        "WHEN suffix(w, 's') AND NOT suffix(w, 'ss') AND length(w) > 3 THEN substr(w, 1, length(w) - 1) ELSE w END"
    )
    return f"list_sort(list_distinct([{fold} FOR w IN {words}]))"


_RANKED = f"""q AS (SELECT question_id, question, {_tokens('question')} AS bag FROM {{questions}}),
  m AS (SELECT * FROM {{catalog}} WHERE status = 'approved'),
  ix AS (SELECT id, name, w, sum(weight) AS weight FROM (SELECT id, name, unnest({_tokens('name')}) AS w, 2 AS weight FROM m
    UNION ALL SELECT id, name, unnest({_tokens('description')}), 1 FROM m) GROUP BY id, name, w),
  bags AS (SELECT DISTINCT bag FROM q),
  sc AS (SELECT bag, id, name, CAST(sum(weight) AS BIGINT) AS score FROM (SELECT bag, unnest(bag) AS w FROM bags) b JOIN ix ON ix.w = b.w GROUP BY bag, id, name),
  rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY bag ORDER BY score DESC, name, id) AS INTEGER) AS rank FROM sc)"""


@query("question_words", f"SELECT question_id, array_to_string({_tokens('question')}, ' ') AS words FROM {{questions}}")
def question_words(spark, sf_dir):
    return derive(spark, sf_dir, "questions").select("question_id", F.array_join(N.words("question"), " ").alias("words"))


@query("question_ranking", f"WITH {_RANKED} SELECT array_to_string(bag, ' ') AS words, name, score, rank FROM rk")
def question_ranking(spark, sf_dir):
    approved = derive(spark, sf_dir, "catalog").filter("status = 'approved'")
    out = N.rank_metrics(derive(spark, sf_dir, "questions"), approved)
    return out.select(F.array_join("bag", " ").alias("words"), "name", "score", "rank")


@query(
    "question_confidence",
    f"""WITH {_RANKED} SELECT array_to_string(bag, ' ') AS words, max(name) FILTER (WHERE rank = 1) AS best,
    max(score) FILTER (WHERE rank = 1) >= 3 AND (max(score) FILTER (WHERE rank = 2) IS NULL
      OR max(score) FILTER (WHERE rank = 1) > max(score) FILTER (WHERE rank = 2)) AS confident,
    string_agg(name, ',' ORDER BY rank) FILTER (WHERE rank <= 5) AS candidates FROM rk GROUP BY bag""",
)
def question_confidence(spark, sf_dir):
    approved = derive(spark, sf_dir, "catalog").filter("status = 'approved'")
    out = N.shortlist(N.rank_metrics(derive(spark, sf_dir, "questions"), approved))
    return out.select(
        F.array_join("bag", " ").alias("words"), F.col("top.name").alias("best"), "confident", F.array_join("candidates", ",").alias("candidates")
    )


_SPECS = """from_json('[{"name":"City","type":"string","has_default":true,"default":"\\\\"any\\\\""},{"name":"kind","type":"string","has_default":true,"default":"\\\\"all\\\\""},{"name":"floor","type":"number","has_default":false}]', '%s')"""


@query(
    "question_bindings",
    """SELECT question_id, CASE WHEN question_id % 3 = 2 THEN '"Boston"' WHEN question_id % 3 = 1 THEN concat('"', regexp_extract(question, '''([^'']+)''', 1), '"') END AS city,
    CASE WHEN question_id % 3 = 2 THEN concat('"', regexp_extract(question, '''([^'']+)''', 1), '"') END AS kind,
    CASE WHEN question_id % 3 > 0 THEN regexp_extract(question, '(?:above|over) ([0-9]+)', 1) END AS floor,
    CASE WHEN question_id % 3 = 0 THEN 'floor' ELSE '' END AS missing FROM {questions}""",
)
def question_bindings(spark, sf_dir):
    asked = derive(spark, sf_dir, "questions").withColumn("params", F.expr(_SPECS % M.PARAMS_TYPE))
    out = N.bind_parameters(asked)
    value = [F.try_element_at("bound", F.lit(k)).alias(k.lower()) for k in ("City", "kind", "floor")]
    return out.select("question_id", *value, F.array_join("missing", ",").alias("missing"))


@query(
    "question_routes",
    f"""WITH {_RANKED}, top AS (SELECT bag, max(name) FILTER (WHERE rank = 1) AS best, count(*) FILTER (WHERE rank <= 5) AS n,
        max(score) FILTER (WHERE rank = 1) AS s1, max(score) FILTER (WHERE rank = 2) AS s2 FROM rk GROUP BY bag),
      j AS (SELECT q.*, best, n, coalesce(s1 >= 3 AND (s2 IS NULL OR s1 > s2), false) AS sure,
        CASE WHEN question_id % 3 = 1 THEN regexp_extract(question, '''([^'']+)''', 1) WHEN question_id % 3 = 2 THEN 'Boston' ELSE 'any' END AS city,
        regexp_extract(question, '(?:above|over) ([0-9]+)', 1) AS floor FROM q LEFT JOIN top ON top.bag = q.bag)
    SELECT question_id, sure AND question_id % 3 = 2 AS answered,
      CASE WHEN sure AND question_id % 3 > 0 THEN best END AS metric,
      CASE WHEN sure AND question_id % 3 = 2 THEN concat('{{{{"sql": "city = ''', city, ''' floor ', floor, '"}}}}') END AS request,
      CASE WHEN sure AND question_id % 3 = 2 THEN NULL WHEN sure AND question_id % 3 = 1 THEN 'parameter ''City'' contains disallowed characters {_NAME_ERROR}'
        WHEN sure THEN concat('metric ''', best, ''' matches but needs parameters: [''floor'']')
        WHEN best IS NULL THEN 'no approved metric matches this question'
        WHEN n = 1 THEN concat('metric ''', best, ''' matches only weakly — not executing') ELSE 'no clear best match among the candidate metrics' END AS reason
    FROM j""",
)
def question_routes(spark, sf_dir):
    specs = """from_json('[{"name":"City","type":"string","has_default":true,"default":"\\\\"any\\\\""},{"name":"floor","type":"number","has_default":false}]', '%s')"""
    metrics = derive(spark, sf_dir, "catalog").withColumns(
        {"params": F.expr(specs % M.PARAMS_TYPE), "template": F.lit("""{"sql": "city = '{City}' floor {floor}"}""")}
    )
    out = N.route_questions(derive(spark, sf_dir, "questions"), metrics)
    return out.select("question_id", "answered", "metric", "request", "reason")
