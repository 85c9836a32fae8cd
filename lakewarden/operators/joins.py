"""Join discovery from schemas and from query logs.

columns_meta: datasource_id, datasource_name, table, table_ordinal, ordinal,
column, type, is_pk, is_fk - one row per column. Edges are undirected: their
key is the pair of endpoints in order, and `from` is the earlier column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewarden.functions.text import alnum_key, quoted, table_stem
from lakewarden.functions.types import joinable, type_family
from lakewarden.operators.policy import visible
from lakewarden.operators.redact import redact_free_text
from lakewarden.operators.skew import ROWS_PER_SALT, salted_join
from lakewarden.session import cut_lineage

# Name endings that mark keys, confidences, and the keywords
# that can follow a table name without being its alias.
KEY_WORDS = ["id", "key", "code", "uuid"]
SAME_NAME, NAMES_TABLE, OBSERVED, PROPOSED = 0.9, 0.8, 0.7, 0.5
SQL_KEYWORDS = [
    "on", "where", "inner", "left", "right", "outer", "full", "cross", "join",
    "using", "group", "order", "limit", "having", "union", "as", "set",
]

EDGE = ["from_datasource_id", "from_table", "from_column", "to_datasource_id", "to_table", "to_column"]
RELATIONSHIP = [*EDGE, "kind", "source", "confidence", "rationale"]

_FROM_JOIN = (
    r"(?iU)\b(?:FROM|JOIN)\s+([A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*)"
    rf"(?:\s+(?:AS\s+)?(?!(?:{'|'.join(SQL_KEYWORDS)})\b)([A-Za-z_]\w*))?"
)
_ON_EQUAL = r"(?iU)\bON\s+([A-Za-z_]\w*)\.([A-Za-z_]\w*)\s*=\s*([A-Za-z_]\w*)\.([A-Za-z_]\w*)"


def edge_key() -> Column:
    """Direction-blind identity of a relationship row."""
    ends = [
        F.struct(*[F.col(f"{side}_{part}").alias(part) for part in ("datasource_id", "table", "column")])
        for side in ("from", "to")
    ]
    return F.array(F.least(*ends), F.greatest(*ends))


def edge_id() -> Column:
    """A stable id, so a recomputed task writes the same one."""
    return F.substring(F.sha2(F.to_json(edge_key()), 256), 1, 32)


def is_key_like(name: Column | str) -> Column:
    return alnum_key(name).rlike(f"(?:{'|'.join(KEY_WORDS)})$")


def _key_columns(columns_meta: DataFrame) -> DataFrame:
    """One row per key-like column: `place` (its endpoint in enumeration order),
    norm, stem and family."""
    order = [c for c in ("table_ordinal",) if c in columns_meta.columns]
    keyed = (
        columns_meta.select(
            F.struct("datasource_id", *order, "table", "ordinal", "column").alias("place"),
            alnum_key("column").alias("norm"),
            table_stem("table").alias("stem"),
            type_family(F.coalesce("type", F.lit(""))).alias("family"),
        )
        .filter(is_key_like("place.column") & F.col("family").isin("numeric", "text"))
    )
    # A repeated name in one table is one endpoint, at its first place.
    first = F.min_by(F.struct("place", "norm", "stem", "family"), "place").alias("k")
    return keyed.groupBy("place.datasource_id", "place.table", "place.column").agg(first).select("k.*")


def detect_candidates(columns_meta: DataFrame, *, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """Candidate joins from names and types, as one equi-join.

    Two columns pair when their names agree after normalisation (0.9), or when
    one names the other's table (0.8). Every column is looked up by its own
    name among the names the others answer to. A name shared by very many
    tables is a hot key, so its rows are cut into slices.
    """
    keys = cut_lineage(_key_columns(columns_meta))

    def table_names(side: str = "") -> list[Column]:
        """What a column elsewhere is called when it names this one's table."""
        stem, norm = F.col(f"{side}stem"), F.col(f"{side}norm")
        return [F.concat(stem, F.lit("id")), F.concat(stem, norm)]

    answers = F.array_distinct(
        F.array(
            F.struct(F.col("norm").alias("key"), F.lit(True).alias("same")),
            *[F.struct(n.alias("key"), F.lit(False).alias("same")) for n in table_names()],
        )
    )
    asking = keys.select(
        F.col("norm").alias("key"), F.col("place").alias("a"), F.col("stem").alias("a_stem"), F.col("norm").alias("a_norm"),
        F.col("family").alias("a_family"),
    )
    answering = keys.select(
        F.col("place").alias("b"), F.col("norm").alias("b_norm"), F.col("family").alias("b_family"), F.inline(answers)
    )
    # Bare id/key/code/uuid names pair with nobody by name alone.
    answering = answering.filter(~F.col("same") | ~F.col("key").isin(KEY_WORDS))
    a, b, same = F.col("a"), F.col("b"), F.col("same")
    elsewhere = (a["datasource_id"] != b["datasource_id"]) | (a["table"] != b["table"])
    found = salted_join(asking, answering, "key", spread_by=["a"], rows_per_salt=rows_per_salt).filter(
        elsewhere & joinable(F.col("a_family"), F.col("b_family"))
    )
    # Rule order: same name, the earlier names the later's table, the reverse.
    # A row that another rule of its pair outranks is dropped where it is found,
    # so pairs never travel again to be compared.
    alike = (F.col("a_norm") == F.col("b_norm")) & ~F.col("a_norm").isin(KEY_WORDS)
    outranked = alike | ((b < a) & F.col("b_norm").isin(*table_names("a_")))
    best = found.filter(F.when(same, a < b).otherwise(~outranked)).select(
        F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.when(same, 0).when(a < b, 1).otherwise(2).alias("rule")
    )
    rule = F.col("rule")

    def says(x: Column, y: Column) -> Column:
        return F.concat(
            x["table"], F.lit("."), x["column"], F.lit(" names the "), y["table"], F.lit(" table's key ("), y["column"],
            F.lit(")"),
        )

    same_name = F.concat(
        F.lit("column names match after normalization ("), quoted(a["column"]), F.lit(" ~ "), quoted(b["column"]),
        F.lit(")"),
    )
    ends = [side[part] for side in (a, b) for part in ("datasource_id", "table", "column")]
    return best.select(
        *[e.alias(n) for e, n in zip(ends, EDGE)],
        F.lit("candidate_join").alias("kind"),
        F.lit("heuristic").alias("source"),
        F.when(rule == 0, SAME_NAME).otherwise(NAMES_TABLE).alias("confidence"),
        F.when(rule == 0, same_name).when(rule == 1, says(a, b)).otherwise(says(b, a)).alias("rationale"),
    )


def joins_in_sql(sql: Column | str) -> Column:
    """array<struct<left_table,left_column,right_table,right_column>> of the
    equi-joins written as FROM/JOIN ... ON a.x = b.y, aliases resolved."""
    text = F.col(sql) if isinstance(sql, str) else sql

    def group(pattern: str, n: int) -> Column:
        return F.regexp_extract_all(text, F.lit(pattern), F.lit(n))

    seen = F.zip_with(group(_FROM_JOIN, 1), group(_FROM_JOIN, 2), lambda t, a: F.struct(
        F.substring_index(t, ".", -1).alias("table"), a.alias("alias")))
    known = F.flatten(
        F.transform(
            seen,
            lambda s: F.filter(
                F.array(
                    F.struct(F.lower(s["table"]).alias("word"), s["table"].alias("table")),
                    F.struct(F.lower(s["alias"]).alias("word"), s["table"].alias("table")),
                ),
                lambda e: e["word"] != "",
            ),
        )
    )
    # The last mention of a word decides what it stands for.
    latest = F.reverse(known)

    def table_of(names: Column, word: Column) -> Column:
        return F.get(F.filter(names, lambda e: e["word"] == F.lower(word)), F.lit(0))["table"]

    pairs = F.zip_with(
        F.zip_with(group(_ON_EQUAL, 1), group(_ON_EQUAL, 2), lambda t, c: F.struct(t.alias("t"), c.alias("c"))),
        F.zip_with(group(_ON_EQUAL, 3), group(_ON_EQUAL, 4), lambda t, c: F.struct(t.alias("t"), c.alias("c"))),
        lambda x, y: F.struct(x.alias("x"), y.alias("y")),
    )
    resolved = F.transform(
        F.array(latest),
        lambda names: F.transform(
            pairs,
            lambda p: F.struct(
                table_of(names, p["x"]["t"]).alias("left_table"),
                p["x"]["c"].alias("left_column"),
                table_of(names, p["y"]["t"]).alias("right_table"),
                p["y"]["c"].alias("right_column"),
            ),
        ),
    )[0]
    return F.filter(resolved, lambda j: j["left_table"] != j["right_table"])


def table_lookup(columns_meta: DataFrame) -> DataFrame:
    """(datasource_id, lookup, table): a table by its lower-case name, or by
    its stem where no table has that name."""
    place = F.struct(*[c for c in ("table_ordinal",) if c in columns_meta.columns], F.lit(0))
    tables = columns_meta.groupBy("datasource_id", "table").agg(F.min(place).alias("place"))
    order = F.struct("place", "table")
    called = tables.select(
        "datasource_id", "table", order.alias("at"),
        F.inline(
            F.array(
                F.struct(F.lower("table").alias("lookup"), F.lit(True).alias("exact")),
                F.struct(table_stem("table").alias("lookup"), F.lit(False).alias("exact")),
            )
        ),
    )
    # Of equal names the last counts, of equal stems the first.
    return called.groupBy("datasource_id", "lookup").agg(
        F.coalesce(
            F.max_by("table", F.when(F.col("exact"), F.col("at"))), F.min_by("table", "at")
        ).alias("table")
    )


def _resolve_endpoints(joins: DataFrame, columns_meta: DataFrame) -> DataFrame:
    """Both endpoints of every written join, checked against the live schema;
    a join with an unknown table or column drops out.

    The two ends are looked up together as rows and folded back, so the schema
    is joined once per step and not once per end.
    """
    lookup = table_lookup(columns_meta)
    live = columns_meta.groupBy("datasource_id", "table", F.lower("column").alias("__col")).agg(
        F.max_by("column", "ordinal").alias("column")
    )
    written = ["datasource_id", "caller", "left_table", "left_column", "right_table", "right_column"]
    ends = joins.select(
        *written, "runs",
        F.posexplode(
            F.array(
                *[F.struct(F.col(f"{s}_table").alias("t"), F.lower(f"{s}_column").alias("c")) for s in ("left", "right")]
            )
        ).alias("side", "end"),
    ).withColumns({"__name": F.lower("end.t"), "__stem": table_stem("end.t"), "__col": F.col("end.c")})

    def by(alias: str) -> DataFrame:
        return lookup.select("datasource_id", F.col("lookup").alias(f"__{alias}"), F.col("table").alias(f"__by_{alias}"))

    found = (
        ends.join(by("name"), ["datasource_id", "__name"], "left")
        .join(by("stem"), ["datasource_id", "__stem"], "left")
        .withColumn("table", F.coalesce("__by_name", "__by_stem"))
        .join(live, ["datasource_id", "table", "__col"])
    )
    at = F.struct("table", "column")
    folded = found.groupBy(*written).agg(
        F.max("runs").alias("runs"),
        F.max(F.when(F.col("side") == 0, at)).alias("left"), F.max(F.when(F.col("side") == 1, at)).alias("right"),
    )
    return folded.filter(F.col("left").isNotNull() & F.col("right").isNotNull())


def mine_query_log(audit: DataFrame, columns_meta: DataFrame, *, latest: int | None = None) -> DataFrame:
    """Joins people ran, as candidates with how often and by how many callers.

    Audit: id, action, success, api_key_id, datasource_id, sql. Equal texts by
    one caller are counted before any parsing, so a join run a billion times
    is parsed once. `latest` keeps only that many most recent queries.
    """
    log = audit.filter((F.col("action") == "query") & F.col("success") & (F.coalesce("sql", F.lit("")) != ""))
    if latest is not None:
        # The bound is on query rows, before the ones without SQL are set aside.
        log = audit.filter((F.col("action") == "query") & F.col("success")).orderBy(F.desc("id")).limit(latest)
        log = log.filter(F.coalesce("sql", F.lit("")) != "")
    caller = F.coalesce(F.when(F.col("api_key_id") != "", F.col("api_key_id")), F.lit("unknown"))
    texts = log.groupBy("datasource_id", "sql", caller.alias("caller")).agg(F.count(F.lit(1)).alias("runs"))
    joins = texts.select("datasource_id", "caller", "runs", F.inline(joins_in_sql("sql")))
    joins = joins.groupBy(
        "datasource_id", "caller", "left_table", "left_column", "right_table", "right_column"
    ).agg(F.sum("runs").alias("runs"))
    edges = _resolve_endpoints(joins, columns_meta).select(
        "caller", "runs", "datasource_id", F.array_sort(F.array("left", "right")).alias("ends")
    )
    per_caller = edges.groupBy("datasource_id", "ends", "caller").agg(F.sum("runs").alias("runs"))
    per_edge = per_caller.groupBy("datasource_id", "ends").agg(
        F.sum("runs").alias("runs"), F.count(F.lit(1)).alias("callers")
    )
    rationale = F.concat(
        F.lit("JOIN..ON observed in "), F.col("runs").cast("string"), F.lit(" audited quer"),
        F.when(F.col("runs") == 1, "y").otherwise("ies"), F.lit(" by "), F.col("callers").cast("string"),
        F.lit(" distinct caller"), F.when(F.col("callers") == 1, "").otherwise("s"),
    )
    a, b = F.col("ends")[0], F.col("ends")[1]
    return per_edge.select(
        F.col("datasource_id").alias("from_datasource_id"), a["table"].alias("from_table"),
        a["column"].alias("from_column"), F.col("datasource_id").alias("to_datasource_id"),
        b["table"].alias("to_table"), b["column"].alias("to_column"),
        F.lit("candidate_join").alias("kind"), F.lit("behavioral").alias("source"),
        F.lit(OBSERVED).alias("confidence"), rationale.alias("rationale"), "runs", "callers",
    )


def strongest_first() -> list[Column]:
    """Sort order of mined joins: most callers, then rationale, then endpoints."""
    return [F.desc("callers"), F.asc("rationale"), *[F.asc(c) for c in EDGE]]


def structural_edges(foreign_keys: DataFrame) -> DataFrame:
    """Foreign keys (datasource_id, from_table, from_column, to_table,
    to_column) as approved-grade relationships."""
    return foreign_keys.select(
        F.col("datasource_id").alias("from_datasource_id"), "from_table", "from_column",
        F.col("datasource_id").alias("to_datasource_id"), "to_table", "to_column",
        F.lit("foreign_key").alias("kind"), F.lit("structural").alias("source"), F.lit(1.0).alias("confidence"),
        F.lit("foreign key constraint in the source database").alias("rationale"),
    )


def propose_relationships(
    proposals: DataFrame, columns_meta: DataFrame, registry: DataFrame, policies: DataFrame, subject: str,
    *, default_deny: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Drafted relationships: (candidates, refused). Proposals carry the edge
    columns, a rationale and `ord`. A source that is unknown or hidden from the
    proposer refuses the draft; a missing column only adds a note."""
    seen = visible(registry.select("id"), "id", policies, subject, default_deny=default_deny)
    known = columns_meta.select("datasource_id").distinct()
    live = columns_meta.select("datasource_id", "table", "column").distinct()
    out = proposals.withColumn("rationale", redact_free_text("rationale"))
    for side in ("from", "to"):
        ds, table, column = (f"{side}_{p}" for p in ("datasource_id", "table", "column"))
        out = (
            out.join(seen.select(F.col("id").alias(ds), F.lit(True).alias(f"__seen_{side}")), ds, "left")
            .join(known.select(F.col("datasource_id").alias(ds), F.lit(True).alias("__known")), ds, "left")
            .join(
                live.select(
                    F.col("datasource_id").alias(ds), F.col("table").alias(table), F.col("column").alias(column),
                    F.lit(True).alias("__live"),
                ),
                [ds, table, column],
                "left",
            )
        )
        note = F.concat(F.lit(" [note: "), F.col(table), F.lit("."), F.col(column),
                        F.lit(" not found in the discovered schema]"))
        missing = F.col("__known").isNotNull() & F.col("__live").isNull()
        out = out.withColumn(
            "rationale", F.concat("rationale", F.when(missing, note).otherwise(F.lit("")))
        ).drop("__known", "__live")
    fine = F.col("__seen_from").isNotNull() & F.col("__seen_to").isNotNull()
    lost = F.when(F.col("__seen_from").isNull(), F.col("from_datasource_id")).otherwise(F.col("to_datasource_id"))
    refused = out.filter(~fine).select(
        *proposals.columns, F.concat(F.lit("datasource not found: "), lost).alias("reason")
    )
    good = out.filter(fine).select(
        *EDGE, F.lit("candidate_join").alias("kind"), F.lit("proposed").alias("source"),
        F.lit(PROPOSED).alias("confidence"), "rationale", "ord",
    )
    return good, refused
