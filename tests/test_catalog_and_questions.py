"""Metric templates and question matching goldens."""

import json

import pytest
from pyspark.sql import functions as F

from lakewarden.operators import metrics as M
from lakewarden.operators import questions as N

TEMPLATE = json.dumps({"sql": "SELECT harbor, count(*) FROM sailors WHERE deck = '{deck}' LIMIT {n}"})
PARAMS = [("deck", "string", None, False), ("n", "number", "10", True)]


def render(spark, bound, status="approved"):
    schema = f"template string, params {M.PARAMS_TYPE}, status string, bound map<string,string>"
    calls = spark.createDataFrame([(TEMPLATE, PARAMS, status, {k: json.dumps(v) for k, v in bound.items()})], schema)
    return M.render_requests(calls).first()


def test_fills_values_and_defaults(spark):
    assert json.loads(render(spark, {"deck": "oak"}).request)["sql"].endswith("deck = 'oak' LIMIT 10")
    assert json.loads(render(spark, {"deck": "oak", "n": 5}).request)["sql"].endswith("LIMIT 5")
    assert json.loads(render(spark, {"deck": True, "n": 1e20}).request)["sql"].endswith("deck = 'True' LIMIT 1e+20")


@pytest.mark.parametrize(
    ("bound", "error"),
    [
        ({}, "missing required parameter: deck"), ({"deck": "oak", "extra": 1}, "unknown parameters: ['extra']"),
        ({"deck": "oak", "n": True}, "parameter 'n' must be a finite number"), ({"deck": "oak", "n": "10"}, "parameter 'n' must be a finite number"),
        ({"deck": "oak", "n": float("inf")}, "parameter 'n' must be a finite number"),
        ({"deck": "oak", "n": float("nan")}, "parameter 'n' must be a finite number"),
    ],
)
def test_refusals(spark, bound, error):
    row = render(spark, bound)
    assert row.error == error and row.request is None


@pytest.mark.parametrize("evil", ["oak'; DELETE FROM c; --", 'a"b', "x{y}", "a;b", "a/b", "x" * 201, "a--b", "oak\n", "a\nb"])
def test_injection_is_refused(spark, evil):
    assert "disallowed" in render(spark, {"deck": evil}).error


def test_only_approved_metrics_run(spark):
    assert render(spark, {"deck": "oak"}, "candidate").error == "metric is not approved (status: candidate)"


CATALOG = [
    ("m1", "tonnage_by_harbor", "Total cargo tonnage grouped by sailor harbor", [("harbor", "string", None, False)]),
    ("m2", "sailor_count", "Number of registered sailors", []),
    ("m3", "top_cargoes", "Largest cargoes above a minimum load", [("min_load", "number", "0", True)]),
]


def route(spark, question, catalog=CATALOG):
    schema = f"id string, name string, description string, params {M.PARAMS_TYPE}"
    metrics = spark.createDataFrame(catalog, schema).withColumns({"template": F.lit("{}"), "status": F.lit("approved")})
    return N.route_questions(spark.createDataFrame([(1, question)], "question_id int, question string"), metrics).first()


def test_routing(spark):
    assert route(spark, "what is the tonnage by harbor 'Bergen'?").answered
    assert route(spark, "how many sailors").metric == "sailor_count"
    assert route(spark, "snow forecast?").reason == "no approved metric matches this question"
    weak = route(spark, "count")
    assert not weak.answered and weak.reason == "metric 'sailor_count' matches only weakly — not executing"
    needs = route(spark, "what is the tonnage by harbor?")
    assert needs.reason == "metric 'tonnage_by_harbor' matches but needs parameters: ['harbor']" and needs.candidates == ["tonnage_by_harbor"]
    tied = route(spark, "cargoes", [(n, f"cargoes_{n}", "x", []) for n in ("north", "south")])
    assert tied.reason == "no clear best match among the candidate metrics" and tied.candidates == ["cargoes_north", "cargoes_south"]


@pytest.mark.parametrize(
    ("question", "bound"),
    [
        ("tonnage harbor=Bergen min_load=50", {"harbor": "Bergen", "min_load": 50}), ("tonnage for 'San Marino' above 100", {"harbor": "San Marino", "min_load": 100}),
        ("tonnage please", {}), ("sailor's tonnage in 'Bergen'", {"harbor": "Bergen"}), ("limit=100 tonnage", {}),
        ("harbor 'Quay 9'", {"harbor": "Quay 9"}), ("tonnage for “Bergen”", {"harbor": "Bergen"}), ("above 2.50", {"min_load": 2.5}),
        ('harbor: "a b" 7', {"harbor": "a b", "min_load": 7}), ("min_load=abc 3", {"min_load": 3}),
    ],
)
def test_binding(question, bound):
    specs = [{"name": "harbor", "type": "string"}, {"name": "min_load", "type": "number"}]
    assert {k: json.loads(v) for k, v in N.bind_words(question, specs).items()} == bound


def test_questions_are_scored_by_the_words_of_the_catalog(spark):
    """Numbers and names that no metric has make questions of their own, but nothing more to score."""
    asked = [(i, f"sailor count of Quay{i} above {i}") for i in range(300)] + [(300, "tonnage by harbor"), (301, "snow 7"), (302, None)]
    questions = spark.createDataFrame(asked, "question_id int, question string")
    metrics = spark.createDataFrame(CATALOG, f"id string, name string, description string, params {M.PARAMS_TYPE}")
    used, ranked = N._rank_sets(questions, metrics)
    assert used.count() == 301 and ranked.select("bag").distinct().count() == 2
    out = {(tuple(r.bag), r["rank"]): (r.name, r.score) for r in N.rank_metrics(questions, metrics).collect()}
    assert len(out) == 901
    assert {v for (bag, rank), v in out.items() if "count" in bag and rank == 1} == {("sailor_count", 5)}
    assert out[("harbor", "tonnage"), 1] == ("tonnage_by_harbor", 6)
    routed = N.route_questions(questions, metrics.withColumns({"template": F.lit("{}"), "status": F.lit("approved")}))
    assert {r.question_id: r.reason for r in routed.filter("question_id > 300").collect()} == dict.fromkeys((301, 302), "no approved metric matches this question")
    assert routed.count() == 303
