"""Rolling failure evidence: summary, active rules, the newest observations, and the exact fold."""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.folds import ordered_fold

# Failure codes with the check that shows them and the reviewer they call for.
CODE_CHECKS = {"numbers": "protected_entities", "coverage": "coverage", "text_fit": "native_text_rendering", "overflow": "visual", "visual": "visual", "immutable_structure": "immutable_structure"}
CODE_REVIEWERS = {"numbers": "source_review", "coverage": "source_review", "text_fit": "visual_review", "overflow": "visual_review", "visual": "table_review", "immutable_structure": "source_review"}
WINDOW_DAYS, MAX_DOCUMENTS = 30, 200
MIN_DOCUMENTS, MIN_FAILURES, MIN_DAYS, MIN_RATE = 3, 2, 1, 0.20


def in_window(ts: Column, now: Column, days: int = WINDOW_DAYS) -> Column:
    """[J1] Both ends belong to the window; later rows don't."""
    return (ts >= now - F.expr(f"interval {days} days")) & (ts <= now)


def evidence(observations: DataFrame, codes: list[str] | None = None) -> DataFrame:
    """[E2] kind, code, documents, failures, failure_days, rate, active; every code has a row for every kind.

    The codes of a row are exploded before one aggregate, so there is no scan for each code.
    """
    codes = codes or list(CODE_CHECKS)
    each = observations.withColumn("code", F.explode(F.array(*[F.lit(c) for c in codes])))
    eligible = F.array_contains("eligible", F.col("code"))
    failed = eligible & F.array_contains("failures", F.col("code"))
    sums = each.groupBy("kind", "code").agg(F.count_if(eligible).alias("documents"), F.count_if(failed).alias("failures"), F.count_distinct(F.when(failed, F.to_date("ts"))).alias("failure_days"))
    rate = F.when(F.col("documents") > 0, F.col("failures") / F.col("documents")).otherwise(0.0)
    active = (F.col("documents") >= MIN_DOCUMENTS) & (F.col("failures") >= MIN_FAILURES) & (F.col("failure_days") >= MIN_DAYS) & (rate >= MIN_RATE)
    return sums.select("kind", "code", "documents", "failures", "failure_days", F.round(rate, 4).alias("rate"), active.alias("active"))


def active_rules(summary: DataFrame) -> DataFrame:
    """[E3, D18] kind, rules: sorted codes in force."""
    return summary.groupBy("kind").agg(F.array_sort(F.collect_list(F.when(F.col("active"), F.col("code")))).alias("rules"))


def latest(observations: DataFrame, n: int = MAX_DOCUMENTS) -> DataFrame:
    """[G2] The newest n observations of each kind."""
    order = Window.partitionBy("kind").orderBy(F.desc("ts"), F.desc("obs_id"))
    return observations.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= n)


class _Window:
    """Documents of the evidence window of one kind, oldest first."""

    def __init__(self):
        self.rows: deque = deque()
        self.held: set = set()

    def admit(self, ts: int, doc, span: int, cap: int) -> bool:
        """Old ones expire, a document that is there already is ignored, the newest cap stay."""
        while self.rows and self.rows[0][0] < ts - span:
            self.held.discard(self.rows.popleft()[1])
        fresh = doc not in self.held
        if fresh:
            self.rows.append((ts, doc))
            self.held.add(doc)
            if len(self.rows) > cap:
                self.held.discard(self.rows.popleft()[1])
        return fresh


def admitted(observations: DataFrame, days: int = WINDOW_DAYS, cap: int = MAX_DOCUMENTS) -> DataFrame:
    """[J2, H6] Rows that the evidence fold admits: kind, obs_id, doc, ts. One ordered pass for each kind; the state is the cap newest documents."""
    rows = observations.select("kind", "obs_id", "doc", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"))
    step = lambda w, r: (r["kind"], r["obs_id"], r["doc"], r["ts"]) if w.admit(r["micros"], r["doc"], days * 86_400_000_000, cap) else None
    return ordered_fold(rows, "kind", ["ts", "obs_id"], "kind string, obs_id long, doc long, ts timestamp_ntz", _Window, step)


def guidance(documents: DataFrame, versions: DataFrame, days: int = 30) -> DataFrame:
    """[M16] documents(doc_id, kind, ts) with the rule that stood at their time, by versions(kind, ts, rule, active), a versioned dimension.

    state is active or inactive as of the document's time, stale where the last version is older than `days`, missing where there is none; rule is given
    while active. A version holds from its time to the next one's and is dealt to the days that it touches; documents stand among the versions of their
    kind and day in order of time, and take the last one before them, so none meets more than one, and a kind with many documents is as many tasks as it
    has days. Of versions of one kind and time, the greatest rule counts.
    """
    once = versions.filter("kind is not null").groupBy("kind", "ts").agg(F.max(F.struct("rule", "active")).alias("v")).select("kind", F.col("ts").alias("since"), "v.rule", "v.active")
    later = F.lead("since").over(Window.partitionBy("kind").orderBy("since"))  # the versions of a kind, not its documents
    end = F.col("since") + F.make_dt_interval(days=F.lit(days + 1))
    spans = once.withColumn("until", F.least(F.coalesce(later, end), end))
    dealt = spans.select("kind", F.explode(F.sequence(F.to_date("since"), F.to_date("until"))).alias("day"), F.col("since").alias("at"), F.struct("since", "rule", "active").alias("own"))
    at = F.col("ts")
    among = documents.withColumns({"day": F.to_date("ts"), "at": at, "is_document": F.lit(True)}).unionByName(dealt.withColumn("is_document", F.lit(False)), allowMissingColumns=True)
    # A day's versions before a document's time, the one from an earlier day too; at one time versions come first.
    held = F.last("own", ignorenulls=True).over(Window.partitionBy("kind", "day").orderBy("at", "is_document").rowsBetween(Window.unboundedPreceding, 0))
    found = among.withColumn("v", held).filter("is_document").select(*documents.columns, "v")
    # Documents behind every interval that they could meet are told from those before the first version by the kind's first time.
    firsts = once.groupBy("kind").agg(F.min("since").alias("first"))
    rows = found.join(firsts, "kind", "left")
    old = F.col("v").isNull() | (at > F.col("v.since") + F.make_dt_interval(days=F.lit(days)))
    state = F.when(F.col("first").isNull() | (F.col("first") > at), "missing").when(old, "stale").when(F.col("v.active"), "active").otherwise("inactive")
    return rows.withColumn("state", state).select(*documents.columns, "state", F.when(F.col("state") == "active", F.col("v.rule")).alias("rule"))
