"""Job queue statements as relational queries over batches and jobs; `now` is always given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TERMINAL = ("passed", "needs_review", "failed", "cancelled", "expired")


def recovered(jobs: DataFrame, now: Column) -> DataFrame:
    """[K1] Jobs with expired leases (strictly before now) queued again, or cancelled if that was asked for."""
    lost = (F.col("state") == "running") & (F.col("lease_until") < now)
    state = F.when(lost, F.when(F.col("cancel_requested"), "cancelled").otherwise("queued")).otherwise(F.col("state"))
    return jobs.withColumn("owner", F.when(~lost | lost.isNull(), F.col("owner"))).withColumn("state", state)


def provider_load(jobs: DataFrame) -> DataFrame:
    """[E8] provider, running."""
    return jobs.filter("state = 'running'").groupBy("provider").agg(F.count("*").alias("running"))


def claimable(jobs: DataFrame, batches: DataFrame, now: Column, max_workers: int = 2, per_provider: int = 2) -> DataFrame:
    """[K2, D1] Jobs that repeated claims would take, in order: id, provider, row_no, claim_no.

    The two limits keep the result to max_workers rows; the inner rank cuts each provider to its own few rows
    before the one global rank.
    """
    load = provider_load(jobs)
    total = jobs.filter("state = 'running'").agg(F.count("*").alias("active"))
    queued = jobs.filter("state = 'queued'").join(batches.filter(F.col("expires") > now).select(F.col("id").alias("batch_id")), "batch_id")
    order = Window.partitionBy("provider").orderBy("row_no")
    own = queued.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= per_provider).join(load, "provider", "left").filter(F.col("rank") <= per_provider - F.coalesce("running", F.lit(0)))
    numbered = own.crossJoin(F.broadcast(total)).withColumn("claim_no", F.row_number().over(Window.orderBy("row_no")))  # one row of totals
    return numbered.filter(F.col("claim_no") <= max_workers - F.col("active")).select("id", "provider", "row_no", F.col("claim_no").cast("long").alias("claim_no"))


def beating(jobs: DataFrame, batches: DataFrame, now: Column) -> DataFrame:
    """[K3, D3] Jobs whose heartbeat may extend the lease."""
    live = batches.filter(F.col("expires") > now).select(F.col("id").alias("batch_id"))
    return jobs.filter("state = 'running' and not cancel_requested and owner is not null").join(live, "batch_id", "left_semi")


def finished(jobs: DataFrame, state: Column) -> DataFrame:
    """[K4, B12] Running jobs of their owner after finishing with `state`; cancellation overrides state and artifact."""
    return jobs.filter("state = 'running' and owner is not null").withColumn("state", F.when(F.col("cancel_requested"), "cancelled").otherwise(state)).withColumn("artifact", F.when(~F.col("cancel_requested"), F.col("artifact"))).withColumn("progress", F.when(state.isin(*TERMINAL), 100).otherwise(0))


def cancelled(jobs: DataFrame) -> DataFrame:
    """[K5] Jobs after a cancellation of all their batches."""
    hit = F.col("state").isin("queued", "running", "waiting_credentials")
    state = F.when(F.col("state").isin("queued", "waiting_credentials"), "cancelled").otherwise(F.col("state"))
    return jobs.withColumn("cancel_requested", F.when(hit, True).otherwise(F.col("cancel_requested"))).withColumn("state", state)


def resumed(jobs: DataFrame) -> DataFrame:
    """[K5, I32] Jobs after a resume: model calls move to previous_model_calls."""
    hit = F.col("state").isin("failed", "cancelled", "waiting_credentials")
    out = jobs.withColumn("previous_model_calls", F.col("previous_model_calls") + F.when(hit, F.col("model_calls")).otherwise(0)).withColumn("model_calls", F.when(hit, 0).otherwise(F.col("model_calls")))
    return out.withColumn("cancel_requested", ~hit & F.col("cancel_requested")).withColumn("progress", F.when(hit, 0).otherwise(F.col("progress"))).withColumn("state", F.when(hit, "queued").otherwise(F.col("state")))


def submit_outcomes(requests: DataFrame, batches: DataFrame, now: Column) -> DataFrame:
    """[K6, E18] id, outcome of requests(id, token_hash, fingerprint)."""
    old = batches.select("id", F.col("token_hash").alias("t"), F.col("fingerprint").alias("f"), "expires")
    outcome = F.when(F.col("expires").isNull(), "created").when(F.col("t") != F.col("token_hash"), "token_invalid").when(F.col("expires") <= now, "expired").when(F.col("f") != F.col("fingerprint"), "key_reused").otherwise("repeated")
    return requests.join(old, "id", "left").select("id", outcome.alias("outcome"))


def authorised(requests: DataFrame, batches: DataFrame, now: Column) -> DataFrame:
    """[K7] id, outcome of requests(id, token_hash): granted, denied or expired."""
    old = batches.select("id", F.col("token_hash").alias("t"), "expires")
    outcome = F.when(F.col("t").isNull() | (F.col("t") != F.col("token_hash")), "denied").when(F.col("expires") <= now, "expired").otherwise("granted")
    return requests.join(old, "id", "left").select("id", outcome.alias("outcome"))


def snapshots(jobs: DataFrame) -> DataFrame:
    """[K7, E7, E9] batch_id, n_jobs, n_terminal, finished, n_artifacts."""
    done = F.col("state").isin(*TERMINAL)
    return jobs.groupBy("batch_id").agg(F.count("*").alias("n_jobs"), F.count_if(done).alias("n_terminal"), F.bool_and(done).alias("finished"), F.count_if(F.col("artifact").isNotNull()).alias("n_artifacts"))


def expired(jobs: DataFrame, batches: DataFrame, now: Column) -> DataFrame:
    """[K8, D2, J7] Jobs after the sweep of batches that expired (at or before now)."""
    old = batches.filter(F.col("expires") <= now).select(F.col("id").alias("batch_id"), F.lit(True).alias("_old"))
    hit = F.coalesce(F.col("_old"), F.lit(False)) & (F.col("state") != "expired")
    out = jobs.join(old, "batch_id", "left")
    return out.withColumn("owner", F.when(~hit, F.col("owner"))).withColumn("cancel_requested", hit | F.col("cancel_requested")).withColumn("state", F.when(hit, "expired").otherwise(F.col("state"))).drop("_old")


def over_limits(files: DataFrame, max_files: int, max_file: int, max_batch: int) -> DataFrame:
    """[C14, F6] Files with the first limit that each breaks, by a running total in upload order."""
    order = Window.partitionBy("batch_id").orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    kind = F.when(F.count("*").over(order) > max_files, "too_many").when(F.col("size") > max_file, "file_too_large").when(F.sum("size").over(order) > max_batch, "batch_too_large")
    return files.withColumn("breach", kind).filter("breach is not null")


def progress(events: DataFrame) -> DataFrame:
    """[J6] job_id, progress (0 to 95), message (2000 characters) of the latest event."""
    latest = events.groupBy("job_id").agg(F.max_by(F.struct("progress", "message"), F.struct("ts", "event_id")).alias("e"))
    return latest.select("job_id", F.greatest(F.lit(0), F.least(F.lit(95), F.col("e.progress"))).alias("progress"), F.left("e.message", F.lit(2000)).alias("message"))


def run_log(entries: DataFrame, n: int = 1000) -> DataFrame:
    """[B10, G3, A33] The newest n entries: a top-k, so tasks send n rows each."""
    return entries.orderBy(F.desc("ts"), F.desc("event_id")).limit(n)


def batch_exits(jobs: DataFrame) -> DataFrame:
    """[E9] batch_id, n_passed, n_needs_review, n_failed, exit_code: 1 where a job failed, else 0."""
    counts = {f"n_{s}": F.count_if(F.col("state") == s) for s in ("passed", "needs_review", "failed")}
    return jobs.groupBy("batch_id").agg(*[c.alias(n) for n, c in counts.items()], F.coalesce(F.bool_or(F.col("state") == "failed"), F.lit(False)).cast("int").alias("exit_code"))
