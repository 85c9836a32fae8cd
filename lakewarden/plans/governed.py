"""Governed queries: policy, mask gate, masked views, SQL, redaction, audit."""

from __future__ import annotations

import datetime as dt
import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lakewarden.functions import pii
from lakewarden.operators import audit as audit_ops
from lakewarden.operators.metrics import render_requests
from lakewarden.operators.policy import credential_basis, decide_one, deny_reason, named_mask, strip_masked, visible
from lakewarden.operators.questions import route_questions
from lakewarden.operators.redact import as_numbers, redact
from lakewarden.sources.sqlplan import objection
from lakewarden.sources.sqltext import is_select, one_statement

_COPIED_SETTINGS = ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions", "spark.sql.ansi.enabled")
_COUNTS = "__pii_counts"


class AccessDenied(Exception):
    """Refused by policy. The message stays generic; `detail` is for the audit."""

    def __init__(self, detail: str):
        super().__init__("access denied by policy")
        self.detail = detail


class NotReadOnly(Exception):
    """The statement is not a single SELECT."""


class QuotaExceeded(Exception):
    """The month's metered queries are used up."""


@dataclass(frozen=True)
class Identity:
    key_id: str
    is_admin: bool = False


@dataclass
class GovernedResult:
    """A lazy result. The query is in the audit log already; its counts exist once an
    action has run, and `record` adds them."""

    dataframe: DataFrame
    lineage: dict
    observation: Observation
    include_pii: bool
    schema: StructType
    _audit: Callable[[dict], None] | None = field(default=None, repr=False)

    def numbers(self) -> DataFrame:
        """The result with the query's own number types; redacted numbers are null."""
        return self.dataframe if self.include_pii else as_numbers(self.dataframe, self.schema)

    @property
    def pii_counts(self) -> dict[str, int]:
        if self.include_pii:
            return {}
        seen = self.observation.get
        return {t: seen[t] for t in pii.PII_TYPES if seen[t]}

    def record(self) -> dict[str, int]:
        """Log the counts of the query's own pass."""
        counts = self.pii_counts
        if self._audit:
            self._audit({"rows": self.observation.get["rows"], "pii_counts": counts,
                         "pii_redactions": sum(counts.values()), "include_pii": self.include_pii})
        return counts


class GovernedSession:
    """Arbitrary Spark SQL over governed views of registered sources.

    A source is a set of named loaders (SparkSession -> DataFrame). Every query
    runs in a session of its own, so views masked for one caller are never
    seen by another, and files cannot be named from SQL.
    """

    def __init__(
        self, spark: SparkSession, policies: DataFrame, *, default_deny: bool = False, audit_path: str | None = None,
        monthly_cap: int | None = None, licensed: bool = False,
    ):
        self.spark, self.policies, self.default_deny = spark, policies, default_deny
        self.audit_path, self.monthly_cap, self.licensed = audit_path, monthly_cap, licensed
        self._sources: dict[str, dict[str, Callable[[SparkSession], DataFrame]]] = {}

    def register(self, source_id: str, tables: dict[str, Callable[[SparkSession], DataFrame]]) -> None:
        self._sources[source_id] = tables

    # --- decisions on one access: one-row frames through the batch operators ---

    def decision(self, source_id: str, identity: Identity, action: str = "read") -> dict:
        decided = decide_one(
            self.policies, identity.key_id, action, source_id, is_admin=identity.is_admin, default_deny=self.default_deny
        )
        row = decided.withColumn("reason", deny_reason()).withColumn("basis", credential_basis(F.col("is_admin"))).first()
        if not row["allowed"]:
            self._log("policy_deny", source_id, identity, {"action": action, "reason": row["reason"]}, success=False)
            raise AccessDenied(row["reason"])
        return row.asDict()

    def _check_text(self, sql: str, source_id: str, identity: Identity, masked: list[str]) -> None:
        masks = F.array(*map(F.lit, masked)).cast("array<string>")
        seen = self._evaluate(reads=is_select(F.lit(sql)), mask=named_mask(F.lit(sql), masks))
        if seen["mask"] is not None:
            reason = f"query text references masked column '{seen['mask']}'"
            self._log("policy_deny", source_id, identity, {"action": "read", "reason": reason}, success=False)
            raise AccessDenied(reason)
        if not seen["reads"]:
            raise NotReadOnly("only SELECT queries are supported")
        if not one_statement(sql):
            raise NotReadOnly("only a single statement is allowed")

    def _check_quota(self) -> None:
        if self.monthly_cap is None or self.audit_path is None:
            return
        now = dt.datetime.now(dt.timezone.utc)
        start = now.replace(day=1, hour=0, minute=0, second=0, microsecond=0)
        log = self.spark.read.schema(audit_ops.AUDIT_SCHEMA + ", day date")
        try:
            this_month = log.parquet(self.audit_path).filter(F.col("day") >= F.lit(start.date()))
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return  # nothing has been logged yet
        used = audit_ops.count_actions_since(this_month, audit_ops.METERED, start).first()["used"]
        if used < self.monthly_cap:
            return
        if self.licensed:
            if used == self.monthly_cap:
                self._log("license_overage", "license", None, {"limit": self.monthly_cap})
            return
        raise QuotaExceeded(f"free tier allows {self.monthly_cap} queries per month")

    # --- queries ---------------------------------------------------------------

    def query(
        self, source_id: str, sql: str, identity: Identity, *, limit: int | None = None, include_pii: bool = False,
        mode: str = "result", numeric: str = "variant",
    ) -> GovernedResult:
        """Run SQL over a source's governed views.

        Masked columns are absent from the views and from the result. The
        result is redacted unless an admin asks for the raw view; mode="view"
        redacts the views instead, so predicates see redacted values too; there
        numbers keep their types and a card number is null. `numeric` is the rule
        of `redact` for the result's numbers.
        """
        if include_pii and not identity.is_admin:
            raise AccessDenied("raw rows require an admin identity")
        if source_id not in self._sources:
            raise KeyError(f"datasource not found: {source_id}")
        self._check_quota()
        decided = self.decision(source_id, identity)
        base = {"request": {"sql": self._redacted(sql)}, "basis": decided["basis"]}
        try:
            result = self._planned(source_id, sql, identity, decided, base, limit, include_pii, mode, numeric)
        except AccessDenied:
            raise  # logged where it was refused
        except Exception as problem:
            self._log("query", source_id, identity, base | {"error": type(problem).__name__}, success=False)
            raise
        self._log("query", source_id, identity, base)
        return result

    def _planned(self, source_id, sql, identity, decided, base, limit, include_pii, mode, numeric) -> GovernedResult:
        masked = decided["masked_columns"]
        self._check_text(sql, source_id, identity, masked)

        session = self.spark.newSession()
        refused = objection(session, sql, list(self._sources[source_id]))
        if refused is not None:
            raise NotReadOnly(refused)
        for key in _COPIED_SETTINGS:
            session.conf.set(key, self.spark.conf.get(key))
        for name, load in self._sources[source_id].items():
            if not re.search(rf"\b{re.escape(name)}\b", sql, re.IGNORECASE):
                continue  # a table the text never names is not read
            view = strip_masked(load(session), masked)
            if mode == "view" and not include_pii:
                view = redact(view, numeric="null")
            view.createOrReplaceTempView(name)
        session.conf.set("spark.sql.runSQLOnFiles", "false")
        rows = strip_masked(session.sql(sql), masked)
        if limit is not None:
            rows = rows.limit(limit)

        seen = Observation("governed")
        if include_pii:
            out = rows.observe(seen, F.count(F.lit(1)).alias("rows"))
        else:
            counted = redact(rows, numeric=numeric, counts=_COUNTS)
            sums = [F.coalesce(F.sum(F.col(_COUNTS)[t]), F.lit(0)).alias(t) for t in pii.PII_TYPES]
            out = counted.observe(seen, F.count(F.lit(1)).alias("rows"), *sums).drop(_COUNTS)
        lineage = {
            "datasource": source_id, "request": base["request"],
            "executed_at": dt.datetime.now(dt.timezone.utc).isoformat(),
        }
        if masked:
            lineage["policy"] = {"masked_columns": masked}

        def finish(details: dict) -> None:
            self._log("query_result", source_id, identity, base | details)

        return GovernedResult(out, lineage, seen, include_pii, rows.schema, finish)

    def _evaluate(self, **columns) -> dict:
        """Column expressions over constants: folded on the driver, no job."""
        return self.spark.sql("SELECT 1").select(*[c.alias(n) for n, c in columns.items()]).first().asDict()

    def _redacted(self, text: str) -> str:
        return self._evaluate(t=pii.redact_text(F.lit(text)))["t"]

    def run_metric(self, metrics: DataFrame, metric_id: str, params: dict, identity: Identity, **options) -> GovernedResult:
        """Fill an approved metric's template and run its `sql` as a governed query."""
        bound = {k: json.dumps(v) for k, v in params.items()}
        call = metrics.filter(F.col("id") == metric_id).withColumn(
            "bound", F.from_json(F.lit(json.dumps(bound)), "map<string,string>")
        )
        row = render_requests(call).select("name", "datasource_id", "request", "error").first()
        if row is None:
            raise KeyError(f"metric not found: {metric_id}")
        safe = {k: json.loads(self._redacted(v)) if isinstance(params[k], str) else params[k] for k, v in bound.items()}
        details = {"name": row["name"], "params": safe}
        if row["error"] is not None:
            self._log("query_metric", row["datasource_id"], identity, details | {"error": row["error"]}, success=False)
            raise ValueError(row["error"])
        result = self.query(row["datasource_id"], json.loads(row["request"])["sql"], identity, **options)
        result.lineage["metric"] = {"id": metric_id, **details}
        self._log("query_metric", row["datasource_id"], identity, details)
        return result

    def ask(self, metrics: DataFrame, question: str, identity: Identity, **options) -> tuple[GovernedResult | None, dict]:
        """(result, decision): answer a question from the metrics the identity
        may see, or say why not with the closest candidates."""
        seen = visible(metrics, "datasource_id", self.policies, identity.key_id,
                       is_admin=identity.is_admin, default_deny=self.default_deny)
        asked = self.spark.createDataFrame([("q", question)], "question_id string, question string")
        routed = route_questions(asked, seen).first().asDict(recursive=True)
        if not routed["answered"]:
            self._log("ask", None, identity, {"question": routed["question"], "reason": routed["reason"]})
            return None, routed
        params = {k: json.loads(v) for k, v in (routed["bound"] or {}).items()}
        result = self.run_metric(metrics, routed["metric_id"], params, identity, **options)
        result.lineage["nl"] = {"question": routed["question"], "matcher": "deterministic", "metric": routed["metric"]}
        self._log("ask", None, identity, {"question": routed["question"], "metric": routed["metric"]})
        return result, routed

    def _log(self, action: str, source_id: str | None, identity: Identity | None, details: dict, success: bool = True) -> None:
        if self.audit_path is None:
            return
        now = dt.datetime.now(dt.timezone.utc)
        row = (
            int(now.timestamp() * 1e6), now, action, "datasource", source_id, identity and identity.key_id, source_id,
            json.dumps(details), success,
        )
        audit_ops.append_audit(self.spark.createDataFrame([row], audit_ops.AUDIT_SCHEMA), self.audit_path)
