"""Metric catalog: named, validated query templates.

Metrics: id, name, description, datasource_id, template (JSON text), params
array<struct<name,type,default,has_default>> in declared order, source,
status, created_at. Defaults and bound values are JSON texts, so "5" and 5
stay apart; bound values come as map<string,string>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewarden.functions.text import col, let, python_float_text, quoted, quoted_list
from lakewarden.operators.redact import redact_free_text

# What placeholders, names and string values may look like.
PLACEHOLDER = r"\{([A-Za-z_][A-Za-z0-9_]*)\}"
PARAM_NAME = r"\A[A-Za-z_][A-Za-z0-9_]*\n?\z"
STRING_VALUE = r"\A[A-Za-z0-9_ .@-]{0,200}\z"
PARAM_TYPES = ["string", "number"]

PARAMS_TYPE = "array<struct<name:string,type:string,default:string,has_default:boolean>>"
_JSON_NUMBER = r"\A-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?\z"


def placeholders(template: Column | str) -> Column:
    """Distinct placeholder names in the keys and values of a JSON template."""
    return F.array_distinct(F.regexp_extract_all(col(template), F.lit(PLACEHOLDER), F.lit(1)))


def _number_text(json: Column) -> Column:
    """A JSON number as its parsed value prints, null when not finite."""
    value = json.try_cast("double")
    whole = F.regexp_replace(json, r"^-0$", "0")
    finite = json.rlike(_JSON_NUMBER) & (F.abs(value) != float("inf"))
    return F.when(finite, F.when(json.rlike(r"[.eE]"), python_float_text(value)).otherwise(whole))


def _plain_text(json: Column) -> Column:
    """A JSON scalar as text; null for anything that is not one."""
    decoded = F.from_json(F.concat(F.lit('{"v":'), json, F.lit("}")), "v string")["v"]
    return (
        F.when(json.startswith('"'), decoded)
        .when(json == "true", "True")
        .when(json == "false", "False")
        .when(json == "null", "None")
        .otherwise(_number_text(json))
    )


def checked_value(name: Column, kind: Column, json: Column) -> Column:
    """struct<text,error>: how one parameter value renders, or why it may not."""
    def judged(v: Column) -> Column:
        number, text = v["number"], v["text"]
        inert = F.coalesce(text.rlike(STRING_VALUE) & ~text.contains("--"), F.lit(False))
        label = F.concat(F.lit("parameter "), quoted(name))
        disallowed = " contains disallowed characters (allowed: letters, digits, space, _ . @ -, no '--', max 200)"
        error = F.when(
            (kind == "number") & number.isNull(), F.concat(label, F.lit(" must be a finite number"))
        ).when((kind != "number") & ~inert, F.concat(label, F.lit(disallowed)))
        return F.struct(F.when(kind == "number", number).otherwise(text).alias("text"), error.alias("error"))

    return let(F.struct(_number_text(json).alias("number"), F.when(kind != "number", _plain_text(json)).alias("text")), judged)


def _first(errors: Column) -> Column:
    return F.get(F.filter(errors, lambda e: e.isNotNull()), F.lit(0))


def definition_errors(metrics: DataFrame) -> DataFrame:
    """Adds `error`: the first problem of each definition, null when sound."""
    per_param = F.transform(
        "params",
        lambda p: F.when(~p["name"].rlike(PARAM_NAME), F.concat(F.lit("invalid parameter name: "), quoted(p["name"])))
        .when(
            ~F.coalesce(p["type"].isin(PARAM_TYPES), F.lit(False)),
            F.concat(F.lit("parameter "), quoted(p["name"]), F.lit(" needs a type of 'string' or 'number'")),
        )
        .when(p["has_default"], checked_value(p["name"], p["type"], p["default"])["error"]),
    )
    names = F.transform("params", lambda p: p["name"])
    used = placeholders("template")
    undeclared, unused = F.array_except(used, names), F.array_except(names, used)
    return metrics.withColumn(
        "error",
        F.coalesce(
            _first(per_param),
            F.when(
                F.size(undeclared) > 0,
                F.concat(F.lit("template references undeclared parameters: "), quoted_list(undeclared)),
            ),
            F.when(
                F.size(unused) > 0,
                F.concat(F.lit("declared parameters never used in the template: "), quoted_list(unused)),
            ),
        ),
    )


def render_requests(calls: DataFrame) -> DataFrame:
    """Adds `request` (template with values in place) and `error` to rows
    carrying template, params, status and bound.

    Values pass an allowlist without braces, so replacing parameters one after
    another equals replacing them all at once.
    """
    calls = calls.withColumn("bound", F.coalesce("bound", F.create_map().cast("map<string,string>")))
    names = F.transform("params", lambda p: p["name"])
    unknown = F.array_except(F.map_keys("bound"), names)
    values = F.transform(
        "params",
        lambda p: F.struct(
            p["name"].alias("name"),
            p["type"].alias("type"),
            F.when(F.array_contains(F.map_keys("bound"), p["name"]), F.try_element_at("bound", p["name"]))
            .when(p["has_default"], p["default"])
            .alias("json"),
        ),
    )
    checked = F.transform(
        "__values",
        lambda v: F.struct(
            v["name"].alias("name"),
            F.when(
                v["json"].isNull(),
                F.struct(
                    F.lit(None).cast("string").alias("text"),
                    F.concat(F.lit("missing required parameter: "), v["name"]).alias("error"),
                ),
            ).otherwise(checked_value(v["name"], v["type"], v["json"])).alias("value"),
        ),
    )
    error = F.coalesce(
        F.when(
            F.col("status") != "approved",
            F.concat(F.lit("metric is not approved (status: "), F.col("status"), F.lit(")")),
        ),
        F.when(F.size(unknown) > 0, F.concat(F.lit("unknown parameters: "), quoted_list(unknown))),
        _first(F.transform("__checked", lambda c: c["value"]["error"])),
    )
    filled = F.aggregate(
        "__checked",
        F.col("template"),
        lambda t, c: F.replace(t, F.concat(F.lit("{"), c["name"], F.lit("}")), c["value"]["text"]),
    )
    return (
        calls.withColumn("__values", values)
        .withColumn("__checked", checked)
        .withColumn("error", error)
        .withColumn("request", F.when(F.col("error").isNull(), filled))
        .drop("__values", "__checked")
    )


def add_metrics(existing: DataFrame, drafts: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(new metric rows, refused drafts with reason). Drafts carry `ord`; a
    name is taken by the catalog or by the earlier draft. Human drafts are
    approved at once, all others wait as candidates."""
    checked = definition_errors(drafts).withColumn("description", redact_free_text("description"))
    sound = checked.filter(F.col("error").isNull())
    first = sound.groupBy("name").agg(F.min("ord").alias("__first"))
    taken = existing.select("name", F.lit(True).alias("__taken")).distinct()
    judged = sound.join(first, "name").join(taken, "name", "left")
    ok = F.col("__taken").isNull() & (F.col("ord") == F.col("__first"))
    added = judged.filter(ok).select(
        F.substring(F.sha2("name", 256), 1, 32).alias("id"),
        "name", "description", "datasource_id", "template", "params", "source",
        F.when(F.col("source") == "human", "approved").otherwise("candidate").alias("status"),
        now.alias("created_at"), now.alias("updated_at"),
    )
    clash = judged.filter(~ok).select("name", "ord", F.concat(F.lit("metric name already exists: "), "name").alias("reason"))
    broken = checked.filter(F.col("error").isNotNull()).select("name", "ord", F.col("error").alias("reason"))
    return added, clash.unionByName(broken)
