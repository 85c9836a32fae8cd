"""Access policy: validation, decisions, masks, reviews and grants (A1-A10).

Policies: name, effect, resource_id, actions array<string>, subjects
array<string>, mask_columns array<string> (empty when the policy masks nothing).
Requests: subject, is_admin, action, datasource_id (other columns pass through).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What a policy may say.
ACTIONS = ["discover", "read"]
EFFECTS = ["allow", "deny"]
WILDCARD = "*"
MAX_NAME = 255
PLACEHOLDERS = ("REPLACE-WITH-DATASOURCE-ID", "REPLACE-WITH-KEY-ID")

_KEY = ["action", "subject", "resource_id"]


def policy_violations(policies: DataFrame) -> DataFrame:
    """Adds `violation`: the first broken rule, null for a sound policy.

    An optional `unknown_conditions` array<string> carries condition keys
    other than the column list.
    """
    def empty_member(c: str) -> Column:
        return F.exists(c, lambda s: s.isNull() | (s == ""))

    masks = F.coalesce("mask_columns", F.array().cast("array<string>"))
    rules = (
        F.when(
            F.coalesce(F.length("name"), F.lit(0)).between(1, MAX_NAME) == F.lit(False),
            "policy name must be 1-255 characters",
        )
        .when(~F.coalesce(F.col("effect").isin(EFFECTS), F.lit(False)), "effect must be one of ['allow', 'deny']")
        .when(
            F.coalesce(F.size("actions") <= 0, F.lit(True))
            | (F.size(F.array_except("actions", F.array(*map(F.lit, ACTIONS)))) > 0),
            "actions must be a non-empty subset of ['discover', 'read']",
        )
        .when(
            F.coalesce(F.size("subjects") <= 0, F.lit(True)) | empty_member("subjects"),
            "subjects must be a non-empty list of key ids (or ['*'])",
        )
        .when(F.coalesce(F.col("resource_id"), F.lit("")) == "", "resource_id must be a datasource id or '*'")
    )
    if "unknown_conditions" in policies.columns:
        rules = rules.when(
            F.size("unknown_conditions") > 0,
            F.concat(
                F.lit("unknown condition keys: ['"), F.array_join(F.array_sort("unknown_conditions"), "', '"), F.lit("']")
            ),
        )
    rules = rules.when(
        F.exists(masks, lambda s: s.isNull() | (s == "")), "conditions.columns must be a list of column names"
    ).when(
        (F.size(masks) > 0) & ((F.col("effect") != "deny") | (F.col("actions") != F.array(F.lit("read")))),
        "column masking requires effect='deny' and actions=['read']",
    )
    return policies.withColumn("violation", rules)


def _effects_by_key(policies: DataFrame) -> DataFrame:
    """One row per (action, subject, resource): what those policies do."""
    masks = F.coalesce("mask_columns", F.array().cast("array<string>"))
    exploded = policies.select(
        "name",
        "effect",
        "resource_id",
        masks.alias("masks"),
        F.explode(F.array_distinct("subjects")).alias("subject"),
        "actions",
    ).withColumn("action", F.explode(F.array_distinct("actions")))
    deny = F.col("effect") == "deny"
    blocks = deny & (F.size("masks") == 0)
    per_mask = exploded.withColumn("mask", F.explode_outer(F.when(deny, F.col("masks"))))
    # Names and masks of one key are distinct policy facts, never data rows.
    return per_mask.groupBy(*_KEY).agg(
        F.min(F.when(blocks, F.col("name"))).alias("denied_by"),
        F.bool_or(~deny).alias("allowed"),
        F.collect_set("mask").alias("masks"),
    )


def decide(requests: DataFrame, policies: DataFrame, *, default_deny: bool = False) -> DataFrame:
    """Adds allowed, denied_by, default_denied and masked_columns to requests.

    A request matches a policy by exact or wildcard subject and resource: three
    lookups into unique-key tables, so requests keep their partitioning and a
    small policy table is broadcast by its measured size. Nothing is exploded
    on the request side, so '*' never becomes a hot shuffle key.
    """
    effects = _effects_by_key(policies)
    what = F.struct("denied_by", "allowed", "masks")
    any_subject, any_resource = F.col("subject") == WILDCARD, F.col("resource_id") == WILDCARD
    lookups = [
        (effects.filter(~any_subject & ~any_resource), {"action": "action", "subject": "subject", "resource_id": "datasource_id"}),
        (effects.filter(~any_subject & any_resource), {"action": "action", "subject": "subject"}),
        (effects.filter(any_subject & ~any_resource), {"action": "action", "resource_id": "datasource_id"}),
    ]
    out = requests
    for i, (table, keys) in enumerate(lookups):
        side = table.select(*[F.col(k).alias(f"__{k}_{i}") for k in keys], what.alias(f"__p{i}"))
        out = out.join(side, [F.col(mine) == F.col(f"__{k}_{i}") for k, mine in keys.items()], "left")
        out = out.drop(*[f"__{k}_{i}" for k in keys])
    # Policies for everyone on everything: one value per action, no join.
    everywhere = effects.filter(any_subject & any_resource)
    per_action = [everywhere.filter(F.col("action") == a).select(what).scalar() for a in ACTIONS]
    chosen = F.when(F.col("action") == ACTIONS[0], per_action[0]).when(F.col("action") == ACTIONS[1], per_action[1])
    out = out.withColumn(f"__p{len(lookups)}", chosen)
    parts = [F.col(f"__p{i}") for i in range(len(lookups) + 1)]
    denied_by = F.least(*[p["denied_by"] for p in parts])
    granted = F.greatest(*[F.coalesce(p["allowed"], F.lit(False)) for p in parts])
    masks = F.array_sort(F.array_distinct(F.concat(*[F.coalesce(p["masks"], _no_names()) for p in parts])))
    return out.select(*requests.columns, *_verdict(denied_by, granted, masks, F.col("is_admin"), default_deny))


def decide_one(
    policies: DataFrame, subject: str, action: str, datasource_id: str, *, is_admin: bool = False,
    default_deny: bool = False,
) -> DataFrame:
    """The same decision for one access, as one aggregate over the policies."""
    applies = (
        F.array_contains("actions", action)
        & (F.array_contains("subjects", WILDCARD) | F.array_contains("subjects", subject))
        & F.col("resource_id").isin(WILDCARD, datasource_id)
    )
    masks = F.coalesce("mask_columns", _no_names())
    deny = F.col("effect") == "deny"
    found = policies.filter(applies).agg(
        F.min(F.when(deny & (F.size(masks) == 0), F.col("name"))).alias("denied"),
        F.coalesce(F.bool_or(~deny), F.lit(False)).alias("granted"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(deny, masks))))).alias("masks"),
    )
    request = {"subject": subject, "is_admin": is_admin, "action": action, "datasource_id": datasource_id}
    return found.select(
        *[F.lit(v).alias(k) for k, v in request.items()],
        *_verdict(F.col("denied"), F.col("granted"), F.col("masks"), F.lit(is_admin), default_deny),
    )


def _no_names() -> Column:
    return F.array().cast("array<string>")


def _verdict(denied_by: Column, granted: Column, masks: Column, admin: Column, default_deny: bool) -> list[Column]:
    """Explicit deny beats explicit allow beats the default; admins bypass."""
    refused = F.lit(default_deny) & ~granted
    allowed = admin | (denied_by.isNull() & ~refused)
    return [
        allowed.alias("allowed"),
        F.when(~admin, denied_by).alias("denied_by"),
        (~admin & denied_by.isNull() & refused).alias("default_denied"),
        F.when(allowed & ~admin, masks).otherwise(_no_names()).alias("masked_columns"),
    ]


def deny_reason() -> Column:
    """Audit text for a decided request; null when it was allowed."""
    return F.when(
        F.col("denied_by").isNotNull(), F.concat(F.lit("denied by policy '"), F.col("denied_by"), F.lit("'"))
    ).when(
        F.col("default_denied"),
        F.concat(F.lit("no allow policy grants '"), F.col("action"), F.lit("' (default-deny is on)")),
    )


def credential_basis(is_admin: Column) -> Column:
    return F.when(is_admin, "admin-bypass").otherwise("policy")


def visible(
    listing: DataFrame, id_column: str, policies: DataFrame, subject: str, *,
    is_admin: bool = False, default_deny: bool = False,
) -> DataFrame:
    """Rows of a listing whose source the subject may discover."""
    if is_admin:
        return listing
    applies = F.array_contains("actions", "discover") & (
        F.array_contains("subjects", WILDCARD) | F.array_contains("subjects", subject)
    )
    deny = F.col("effect") == "deny"
    blocks = deny & (F.size(F.coalesce("mask_columns", _no_names())) == 0)
    facts = [
        F.coalesce(F.bool_or(blocks), F.lit(False)).alias("__blocked"),
        F.coalesce(F.bool_or(~deny), F.lit(False)).alias("__granted"),
    ]
    relevant = policies.filter(applies)
    everywhere = F.col("resource_id") == WILDCARD
    overall = relevant.filter(everywhere).agg(*facts)
    by_source = relevant.filter(~everywhere).groupBy(F.col("resource_id").alias("__id")).agg(*facts)

    def either(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(False)) | overall.select(name).scalar()

    joined = listing.join(by_source, F.col(id_column) == F.col("__id"), "left")
    seen = joined.filter(~either("__blocked") & (either("__granted") | F.lit(not default_deny)))
    return seen.select(*listing.columns)


def review_access(pairs: DataFrame, policies: DataFrame, *, default_deny: bool = False) -> DataFrame:
    """For every (subject, is_admin, datasource_id): read, discover and masks.

    Review one subject by adding it as a constant to the source list, or a
    whole deployment by passing the pairs seen in its audit trail.
    """
    asked = pairs.select("subject", "is_admin", "datasource_id").distinct()
    read = decide(asked.withColumn("action", F.lit("read")), policies, default_deny=default_deny)
    read = read.select("subject", "is_admin", "datasource_id", F.col("allowed").alias("read"), "masked_columns")
    found = decide(
        read.select("subject", "is_admin", "datasource_id", "read", F.col("masked_columns").alias("__masks"),
                    F.lit("discover").alias("action")),
        policies,
        default_deny=default_deny,
    )
    return found.select(
        "subject", "is_admin", "datasource_id", "read", F.col("allowed").alias("discover"),
        F.col("__masks").alias("masked_columns"),
    )


# --- masks -------------------------------------------------------------------

def _strip(c: Column, dtype: T.DataType, masked: set[str]) -> Column:
    if isinstance(dtype, T.StructType):
        kept = [f for f in dtype.fields if f.name.lower() not in masked]
        fields = [_strip(c[f.name], f.dataType, masked).alias(f.name) for f in kept]
        return F.when(c.isNotNull(), F.struct(*fields))
    if isinstance(dtype, T.ArrayType):
        return F.transform(c, lambda v: _strip(v, dtype.elementType, masked))
    if isinstance(dtype, T.MapType):
        value = c
        if isinstance(dtype.keyType, T.StringType):
            value = F.map_filter(value, lambda k, v: ~F.lower(k).isin(sorted(masked)))
        if isinstance(dtype.valueType, (T.StructType, T.ArrayType, T.MapType)):
            value = F.transform_values(value, lambda k, v: _strip(v, dtype.valueType, masked))
        return value
    return c


def strip_masked(df: DataFrame, masked: list[str]) -> DataFrame:
    """Drop masked names, whatever their case, at every depth."""
    names = {m.lower() for m in masked}
    if not names:
        return df
    # By position, since a query's result may have equal names.
    placed = df.toDF(*[f"__{i}" for i in range(len(df.columns))])
    return placed.select(
        *[
            _strip(F.col(f"__{i}"), f.dataType, names).alias(f.name)
            for i, f in enumerate(df.schema.fields)
            if f.name.lower() not in names
        ]
    )


def named_mask(sql: Column, masks: Column) -> Column:
    """First masked column (sorted, lower case) that a query text names.

    A mask of word characters is named exactly when it is one of the text's
    words, so the words are intersected with the masks; only other masks
    (with blanks or dashes) need a search each.
    """
    wanted = F.array_distinct(F.transform(masks, lambda m: F.lower(m)))
    plain = F.filter(wanted, lambda m: m.rlike(r"(?U)\A\w+\z"))
    other = F.filter(wanted, lambda m: ~m.rlike(r"(?U)\A\w+\z"))
    words = F.regexp_extract_all(F.lower(sql), F.lit(r"(?U)(\w+)"), F.lit(1))
    quoted = F.filter(
        other,
        lambda m: F.regexp_like(
            sql, F.concat(F.lit(r"(?iU)\b\Q"), F.replace(m, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E\b"))
        ),
    )
    return F.array_min(F.concat(F.array_intersect(words, plain), quoted))


def gate_queries(queries: DataFrame, masks: DataFrame) -> DataFrame:
    """Adds `named_mask` to queries (datasource_id, sql); masks hold one row
    per (datasource_id, column). Masks are folded to one array per source
    first, so no query row is multiplied."""
    per_source = masks.groupBy("datasource_id").agg(F.array_sort(F.collect_set(F.lower("column"))).alias("__masks"))
    none = F.array().cast("array<string>")
    return (
        queries.join(per_source, "datasource_id", "left")
        .withColumn("named_mask", named_mask(F.col("sql"), F.coalesce("__masks", none)))
        .drop("__masks")
    )


# --- grants ------------------------------------------------------------------

def resolve_sources(asked: DataFrame, registry: DataFrame) -> DataFrame:
    """Adds matched id, label and problem to requests naming a source by id or
    name. Registry: id, name. A shared name is refused, not guessed."""
    by_id = registry.select(F.col("id").alias("__id"), F.col("name").alias("__id_name"))
    by_name = registry.groupBy(F.col("name").alias("__name")).agg(
        F.count(F.lit(1)).alias("__n"), F.min("id").alias("__name_id")
    )
    joined = asked.join(by_id, F.col("source") == F.col("__id"), "left").join(
        by_name, F.col("source") == F.col("__name"), "left"
    )
    unique = F.col("__n") == 1
    return joined.select(
        *asked.columns,
        F.when(F.col("__id").isNotNull(), F.col("__id")).when(unique, F.col("__name_id")).alias("resource_id"),
        F.when(F.col("__id").isNotNull(), F.col("__id_name")).when(unique, F.col("source")).alias("label"),
        F.when(F.col("__id").isNotNull() | unique, F.lit(None).cast("string"))
        .when(
            F.col("__n") > 1,
            F.concat(F.col("source"), F.lit(" (ambiguous: "), F.col("__n").cast("string"),
                     F.lit(" sources share this name — use an id)")),
        )
        .otherwise(F.col("source"))
        .alias("problem"),
    )


def grant_policies(asked: DataFrame, registry: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Allow policies for (subject, source, actions) requests; source '*' grants
    every source. Returns (new policies, refused requests)."""
    everything = asked.filter(F.col("source") == WILDCARD).select(
        *asked.columns, F.lit(WILDCARD).alias("resource_id"), F.lit("all sources").alias("label"),
        F.lit(None).cast("string").alias("problem"),
    )
    resolved = resolve_sources(asked.filter(F.col("source") != WILDCARD), registry).unionByName(everything)
    suffix = F.when(F.col("resource_id") == WILDCARD, "all").otherwise(F.col("label"))
    named = resolved.filter(F.col("problem").isNull()).select(
        F.concat_ws("-", F.lit("allow"), F.col("subject"), suffix).alias("name"),
        F.concat(F.lit("Grant "), F.col("subject"), F.lit(" "), F.array_join("actions", "+"), F.lit(" on "),
                 F.col("label")).alias("description"),
        F.lit("allow").alias("effect"),
        "resource_id",
        "actions",
        F.array("subject").alias("subjects"),
        F.array().cast("array<string>").alias("mask_columns"),
    )
    fresh = named.join(existing.select("name").distinct(), "name", "left_anti")
    # Repeated asks share a name: the first by resource wins, the rest exist by then.
    one = fresh.groupBy("name").agg(F.min_by(F.struct(*[c for c in fresh.columns if c != "name"]), "resource_id").alias("p"))
    return one.select("name", "p.*"), resolved.filter(F.col("problem").isNotNull())


def fill_examples(examples: DataFrame, datasource_id: str | None, subject: str | None) -> DataFrame:
    """Example policies with placeholders filled; rows still needing one are dropped."""
    source_mark, subject_mark = PLACEHOLDERS
    wants_source = F.col("resource_id") == source_mark
    wants_subject = F.array_contains("subjects", subject_mark)
    ready = (~wants_source | F.lit(datasource_id is not None)) & (~wants_subject | F.lit(subject is not None))
    return (
        examples.filter(ready)
        .withColumn("resource_id", F.when(wants_source, F.lit(datasource_id)).otherwise(F.col("resource_id")))
        .withColumn(
            "subjects",
            F.transform("subjects", lambda s: F.when(s == subject_mark, F.lit(subject)).otherwise(s)),
        )
    )


# --- grant audit ---------------------------------------------------------------

# Privileges that cannot change data, by engine and grant kind.
READ_SAFE = {
    "oracle": {
        "system": [
            "CREATE SESSION", "ALTER SESSION", "SELECT ANY TABLE", "READ ANY TABLE", "SELECT ANY DICTIONARY",
            "SELECT ANY SEQUENCE",
        ],
        "object": ["SELECT", "READ", "INHERIT PRIVILEGES"],
    },
    "sqlserver": {
        "system": [
            "CONNECT", "SELECT", "SHOWPLAN", "VIEW ANY COLUMN ENCRYPTION KEY DEFINITION",
            "VIEW ANY COLUMN MASTER KEY DEFINITION", "VIEW DATABASE STATE", "VIEW DEFINITION",
        ],
    },
}
# What makes a login a writer where roles or table privileges decide.
POSTGRES_WRITES = ["INSERT", "UPDATE", "DELETE", "TRUNCATE", "SUPERUSER"]
SQLSERVER_WRITER_ROLES = ["sysadmin", "db_owner"]


def unsafe_grants(grants: DataFrame, memberships: DataFrame) -> DataFrame:
    """Privileges that let a login write: direct, through a role or PUBLIC.

    Grants: engine, grantee, kind (system/object), privilege.
    Memberships: engine, login, role, one row per role; a login without roles
    has one row with a null role. Returns engine, login, privileges (sorted).
    """
    safe = F.lit(False)
    for engine, kinds in READ_SAFE.items():
        for kind, names in kinds.items():
            safe = safe | ((F.col("engine") == engine) & (F.col("kind") == kind) & F.col("privilege").isin(names))
    safe = F.when(F.col("engine") == "postgres", ~F.col("privilege").isin(POSTGRES_WRITES)).otherwise(safe)
    unsafe = grants.filter(~safe).select("engine", "grantee", "privilege").distinct()
    logins = memberships.select("engine", "login").distinct()
    holds = (
        memberships.filter(F.col("role").isNotNull()).select("engine", "login", F.col("role").alias("grantee"))
        .unionByName(logins.select("engine", "login", F.col("login").alias("grantee")))
        .unionByName(logins.select("engine", "login", F.lit("PUBLIC").alias("grantee")))
        .distinct()
    )
    through_roles = memberships.filter(
        (F.col("engine") == "sqlserver") & F.col("role").isin(SQLSERVER_WRITER_ROLES)
    ).select("engine", "login", F.concat(F.lit("member of "), F.col("role")).alias("privilege"))
    found = holds.join(unsafe, ["engine", "grantee"]).select("engine", "login", "privilege").unionByName(through_roles)
    # At most the engine's privilege list per login.
    return found.groupBy("engine", "login").agg(F.array_sort(F.collect_set("privilege")).alias("privileges"))
