"""Batch transitions of relationship, metric and policy tables.

Each transition returns the next snapshot; write it to a new table version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakewarden.operators.joins import EDGE, RELATIONSHIP, edge_id, edge_key, structural_edges

STATE = ["id", *EDGE, "kind", "source", "status", "confidence", "rationale", "created_at", "updated_at"]


def upsert_relationships(state: DataFrame, incoming: DataFrame, now: Column) -> DataFrame:
    """Next relationship snapshot plus `change`: created, upgraded or kept.

    One row per undirected edge. Rows already there keep their review, except
    that a structural fact replaces a guess in place. Incoming rows carry
    `ord`; copies of one edge are folded before the join.
    """
    body = F.struct(*RELATIONSHIP)
    place = F.struct("ord", *EDGE)
    folded = (
        incoming.withColumn("edge", edge_key())
        .groupBy("edge")
        .agg(
            F.min_by(body, place).alias("first"),
            F.min_by(body, F.when(F.col("source") == "structural", place)).alias("any_fact"),
            F.bool_or(F.col("source") == "structural").alias("has_fact"),
        )
        .withColumn("fact", F.when(F.col("has_fact"), F.col("any_fact")))
        .drop("any_fact", "has_fact")
    )
    old = state.withColumn("edge", edge_key()).select("edge", F.struct(*STATE).alias("old"))
    both = old.join(folded, "edge", "full_outer")
    is_new = F.col("old").isNull()
    upgraded = ~is_new & F.col("fact").isNotNull() & (F.col("old.source") != "structural")
    source_row = F.coalesce("fact", "first")
    takes_new = is_new | upgraded

    def field(name: str) -> Column:
        return F.when(takes_new, source_row[name]).otherwise(F.col(f"old.{name}")).alias(name)

    named = both.select(
        "edge", "old", "fact", *[field(n) for n in RELATIONSHIP],
        F.when(is_new, "created").when(upgraded, "upgraded").otherwise("kept").alias("change"),
    )
    structural = F.col("fact").isNotNull()
    fresh = F.col("change") == "created"
    changed = F.col("change") != "kept"
    return named.select(
        F.when(fresh, edge_id()).otherwise(F.col("old.id")).alias("id"),
        *EDGE,
        "kind",
        "source",
        F.when(changed & structural, "approved").when(fresh, "candidate").otherwise(F.col("old.status")).alias("status"),
        F.when(changed & structural, 1.0).otherwise(F.col("confidence")).alias("confidence"),
        "rationale",
        F.when(fresh, now).otherwise(F.col("old.created_at")).alias("created_at"),
        F.when(changed, now).otherwise(F.col("old.updated_at")).alias("updated_at"),
        "change",
    )


def add_candidates(state: DataFrame, candidates: list[DataFrame], now: Column) -> DataFrame:
    """What `upsert_relationships` gives for several frames one after another, where no frame
    holds an edge twice and none holds a structural fact: known edges are kept, others are
    created by the first frame that has them.

    Such rows need neither folding nor old values, so only edges meet, sorted by their
    hashes. An edge that the state itself holds k times leaves k rows for each of them.
    """
    key = ["hash", "edge"]

    def keyed(rows: DataFrame) -> DataFrame:
        return rows.withColumn("edge", edge_key()).withColumn("hash", F.xxhash64("edge"))

    known = keyed(state)
    copies = F.count(F.lit(1)).over(Window.partitionBy(*key))
    kept = known.withColumn("copies", copies).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")))
    out = kept.select(*STATE, F.lit("kept").alias("change"))
    before: list[DataFrame] = []
    for rows in candidates:
        rows = keyed(rows.select(*RELATIONSHIP))
        fresh = rows.join(known.select(*key), key, "left_anti")
        for earlier in before:
            # Edges of both, so that the larger frame is looked through and need not be sorted.
            fresh = fresh.join(earlier.select(*key).join(rows.select(*key), key, "left_semi"), key, "left_anti")
        before.append(rows)
        out = out.unionByName(
            fresh.select(
                edge_id().alias("id"), *EDGE, "kind", "source", F.lit("candidate").alias("status"), "confidence", "rationale",
                now.alias("created_at"), now.alias("updated_at"), F.lit("created").alias("change"),
            )
        )
    return out


def sync_structural(state: DataFrame, datasource_ids: DataFrame, foreign_keys: DataFrame, now: Column) -> DataFrame:
    """Reconcile foreign keys of rediscovered sources: add or upgrade the
    current ones, drop structural rows whose key is gone. Adds `change`."""
    facts = structural_edges(foreign_keys).withColumn("ord", F.lit(0))
    merged = upsert_relationships(state, facts, now).withColumn("edge", edge_key())
    current = facts.select(edge_key().alias("edge"), F.lit(True).alias("__current")).distinct()
    rediscovered = datasource_ids.select(
        F.col("datasource_id").alias("from_datasource_id"), F.lit(True).alias("__rediscovered")
    ).distinct()
    gone = (F.col("source") == "structural") & F.col("__rediscovered").isNotNull() & F.col("__current").isNull()
    return (
        merged.join(current, "edge", "left")
        .join(rediscovered, "from_datasource_id", "left")
        .filter(~gone)
        .select(*STATE, "change")
    )


def review(state: DataFrame, reviews: DataFrame, now: Column, *, structural_fixed: bool = True) -> DataFrame:
    """Apply the latest review (id, status, ord) per row. Adds previous_status
    and outcome: applied, conflict (structural rows are facts) or untouched."""
    latest = reviews.groupBy("id").agg(F.max_by("status", "ord").alias("__new"))
    joined = state.join(latest, "id", "left")
    refused = F.lit(structural_fixed) & (F.col("source") == "structural")
    asked = F.col("__new").isNotNull()
    applied = asked & ~refused
    changes = {"status": F.when(applied, F.col("__new")).otherwise(F.col("status"))}
    if "updated_at" in state.columns:
        changes["updated_at"] = F.when(applied, now).otherwise(F.col("updated_at"))
    return (
        joined.withColumn("previous_status", F.when(applied, F.col("status")))
        .withColumn("outcome", F.when(asked & refused, "conflict").when(applied, "applied").otherwise("untouched"))
        .withColumns(changes)
        .drop("__new")
    )


def prune_candidates(state: DataFrame, columns_meta: DataFrame) -> DataFrame:
    """Drop unreviewed rows with an endpoint gone from a known source."""
    ends = state.filter(F.col("status") == "candidate").select(
        "id",
        F.inline(
            F.array(
                *[
                    F.struct(*[F.col(f"{s}_{p}").alias(p) for p in ("datasource_id", "table", "column")])
                    for s in ("from", "to")
                ]
            )
        ),
    )
    known = columns_meta.select("datasource_id").distinct()
    live = columns_meta.select("datasource_id", "table", "column").distinct()
    lost = ends.join(known, "datasource_id", "left_semi").join(live, ["datasource_id", "table", "column"], "left_anti")
    return state.join(lost.select("id").distinct(), "id", "left_anti")


def drop_sources(
    deleted: DataFrame, relationships: DataFrame, metrics: DataFrame, policies: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What is left once sources (datasource_id) are deleted."""
    ids = deleted.select(F.col("datasource_id").alias("__gone")).distinct()
    rels = relationships
    for side in ("from_datasource_id", "to_datasource_id"):
        rels = rels.join(ids, F.col(side) == F.col("__gone"), "left_anti")
    return (
        rels,
        metrics.join(ids, F.col("datasource_id") == F.col("__gone"), "left_anti"),
        policies.join(ids, F.col("resource_id") == F.col("__gone"), "left_anti"),
    )


def list_relationships(state: DataFrame, *, status: str | None = None, datasource_id: str | None = None) -> DataFrame:
    out = state
    if status:
        out = out.filter(F.col("status") == status)
    if datasource_id:
        out = out.filter((F.col("from_datasource_id") == datasource_id) | (F.col("to_datasource_id") == datasource_id))
    return out.orderBy("created_at", "id")


def list_metrics(metrics: DataFrame, *, status: str | None = None) -> DataFrame:
    return (metrics.filter(F.col("status") == status) if status else metrics).orderBy("created_at", "id")


def outstanding_proposals(relationships: DataFrame, metrics: DataFrame) -> DataFrame:
    """One row: how many unreviewed drafts wait in the queue."""
    waiting = F.col("status") == "candidate"
    rels = relationships.filter(waiting & F.col("source").isin("proposed", "behavioral")).select(F.lit(1).alias("n"))
    drafts = metrics.filter(waiting).select(F.lit(1).alias("n"))
    return rels.unionByName(drafts).agg(F.count("n").alias("outstanding"))


def schema_relationships(state: DataFrame, visible_ids: DataFrame) -> DataFrame:
    """Approved then candidate rows with both ends visible; rejected hidden."""
    ids = visible_ids.select(F.col("datasource_id").alias("__v")).distinct()
    out = state.filter(F.col("status").isin("approved", "candidate"))
    for side in ("from_datasource_id", "to_datasource_id"):
        out = out.join(ids, F.col(side) == F.col("__v"), "left_semi")
    rank = F.when(F.col("status") == "approved", 0).otherwise(1)
    return out.withColumn("status_rank", rank).orderBy("status_rank", "created_at", "id")


def _json_text(c: Column) -> Column:
    """A string as a JSON scalar, which is also a YAML double-quoted one."""
    wrapped = F.to_json(F.struct(c.alias("v")))
    return F.substring(wrapped, F.lit(6), F.length(wrapped) - 6)


def export_relationships(state: DataFrame, visible_ids: DataFrame | None = None) -> DataFrame:
    """Approved relationships as YAML text, one row (`block`) per relationship
    with its sort columns; write with `.select("block").write.text(...)`."""
    out = state.filter(F.col("status") == "approved")
    if visible_ids is not None:
        out = schema_relationships(out, visible_ids)
    q = _json_text

    def end(side: str) -> Column:
        return q(F.concat(F.col(f"{side}_datasource_id"), F.lit("/"), F.col(f"{side}_table"), F.lit("."),
                          F.col(f"{side}_column")))

    block = F.concat(
        F.lit("  - from: "), end("from"), F.lit("\n    to: "), end("to"), F.lit("\n    kind: "), q(F.col("kind")),
        F.lit("\n    source: "), q(F.col("source")), F.lit("\n    confidence: "), F.col("confidence").cast("string"),
    )
    return out.select("created_at", "id", block.alias("block")).orderBy("created_at", "id")


def export_metrics(metrics: DataFrame, visible_ids: DataFrame | None = None) -> DataFrame:
    """Approved metrics as YAML text, one row (`block`) per metric."""
    out = metrics.filter(F.col("status") == "approved")
    if visible_ids is not None:
        out = out.join(visible_ids.select("datasource_id").distinct(), "datasource_id", "left_semi")
    q = _json_text
    block = F.concat(
        F.lit("  - name: "), q(F.col("name")), F.lit("\n    description: "), q(F.col("description")),
        F.lit("\n    datasource: "), q(F.col("datasource_id")), F.lit("\n    template: "), q(F.col("template")),
        F.lit("\n    params: "), q(F.col("params_json")),
    )
    return out.select("created_at", "id", block.alias("block")).orderBy("created_at", "id")
