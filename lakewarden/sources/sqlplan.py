"""What a query text would do, read from Spark's own parse of it."""

from __future__ import annotations

import json

from pyspark.errors import ParseException
from pyspark.sql import SparkSession

#: Functions that run code of the JVM.
REFUSED_FUNCTIONS = {"reflect", "java_method", "try_reflect"}
#: Parsed nodes that only read.
READING_NODES = {
    "Aggregate", "CTERelationDef", "CTERelationRef", "Distinct", "Except", "Expand", "Filter", "Generate", "GlobalLimit", "Intersect",
    "Join", "LateralJoin", "LocalLimit", "LocalRelation", "Offset", "OneRowRelation", "PipeOperator", "Pivot", "Project", "RepartitionByExpression",
    "RebalancePartitions", "Repartition", "Sample", "Sort", "SubqueryAlias", "Tail", "UnresolvedHint", "UnresolvedWith", "Union",
    "Unpivot", "Window", "WithWindowDefinition", "AsOfJoin", "TableValuedFunction",
}
_LOGICAL = "org.apache.spark.sql.catalyst.plans.logical."
_SPARK = "org.apache.spark.sql.catalyst."


def _nodes(tree):
    if isinstance(tree, dict):
        if "class" in tree:
            yield tree
        for value in tree.values():
            yield from _nodes(value)
    elif isinstance(tree, list):
        for value in tree:
            yield from _nodes(value)


def _parts(name) -> list[str]:
    if isinstance(name, dict):  # an identifier: name, and schema or catalog if given
        return [v for k, v in name.items() if k != "product-class" and v]
    return [p.strip() for p in str(name).strip("[]").split(",")]


def objection(spark: SparkSession, sql: str, relations: list[str]) -> str | None:
    """Why a text is no plain read of ``relations`` (and of its own CTEs), or None.

    Nothing is executed. Commands and inserts, relations of other catalogs, schemas or
    files, names made at run time, and functions that are not Spark's own are refused,
    at every depth.
    """
    try:
        parsed = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except ParseException as problem:
        return f"not a query: {problem.getCondition()}"
    except Exception as problem:  # the parser's exception may come through unconverted
        return f"not a query: {type(problem).__name__}"
    nodes = list(_nodes(json.loads(parsed.toJSON())))
    own = {r["_1"].lower() for n in nodes for r in n.get("cteRelations") or []}
    for name in own:
        if spark.catalog.tableExists(name):
            return f"a CTE has the name of a table: {name}"
    known = own | {r.lower() for r in relations}
    functions = None
    for node in nodes:
        full = node["class"]
        kind = full.rsplit(".", 1)[-1].rstrip("$")
        if not full.startswith(_SPARK) or (full.startswith(_LOGICAL) and kind not in READING_NODES):
            return f"only SELECT queries are supported, not {kind}"
        if "UnresolvedIdentifier" in kind:
            return "names must be written out"
        if kind == "UnresolvedRelation":
            parts = _parts(node["multipartIdentifier"])
            if len(parts) != 1 or parts[0].lower() not in known:
                return f"unknown relation: {'.'.join(parts)}"
        if kind in ("UnresolvedFunction", "UnresolvedTableValuedFunction", "UnresolvedGenerator"):
            parts = _parts(node.get("nameParts") or node.get("name"))
            if functions is None:
                functions = {r[0].lower() for r in spark.sql("SHOW SYSTEM FUNCTIONS").collect()}  # a few hundred names
            if len(parts) != 1 or parts[0].lower() in REFUSED_FUNCTIONS or parts[0].lower() not in functions:
                return f"function is not available: {'.'.join(parts)}"
    return None
