"""Streaming forms of the ordered folds: evidence, limiter and leases, with state for each key.

With expire, the state of a key goes when nothing has come for it for as long as its rows can matter (processing time); that is for
streams that go on: a run to the end of what is there would wait for the timeouts.
"""

from __future__ import annotations

import tempfile
import uuid
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillspark.operators.feedback import MAX_DOCUMENTS, WINDOW_DAYS
from quillspark.operators.limits import decide


TIMEOUT = {False: GroupStateTimeout.NoTimeout, True: GroupStateTimeout.ProcessingTimeTimeout}


def limited_stream(requests: DataFrame, limit: int = 30, window: float = 60, expire: bool = False) -> DataFrame:
    """[J4] Decisions of the limiter for a stream of requests(identity, request_id, ts). Rows of a batch go in time order; the state holds at most `limit` times."""

    def run(key: tuple, groups: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            return state.remove()
        rows = pd.concat(list(groups)).sort_values(["ts", "request_id"])
        times = list(state.get[0]) if state.exists else []
        wait = [decide(times, t, limit, window) for t in (rows["ts"].to_numpy().astype("datetime64[us]").astype("int64") / 1e6).tolist()]
        state.update((times,))
        if expire:
            state.setTimeoutDuration(int(window * 1000) + 1)
        yield rows.assign(accepted=[w is None for w in wait], retry_seconds=pd.array(wait, dtype="Int64"))[["identity", "request_id", "ts", "accepted", "retry_seconds"]]

    return requests.select("identity", "request_id", "ts").groupBy("identity").applyInPandasWithState(run, "identity long, request_id long, ts timestamp_ntz, accepted boolean, retry_seconds long", "times array<double>", "append", TIMEOUT[expire])


def admitted_stream(observations: DataFrame, days: int = WINDOW_DAYS, cap: int = MAX_DOCUMENTS, expire: bool = False) -> DataFrame:
    """[J1, J2] Observations that the evidence fold admits; the state holds at most `cap` documents with their times.

    Rows are ordered inside a micro-batch; one that comes in a later batch than a newer row is judged by the documents held then.
    """
    span = days * 86_400.0

    def run(key: tuple, groups: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            return state.remove()
        rows = pd.concat(list(groups)).sort_values(["ts", "obs_id"])
        held = deque(zip(*state.get, strict=True)) if state.exists else deque()
        known, fresh = {doc for _, doc in held}, []
        for t, doc in zip((rows["ts"].to_numpy().astype("datetime64[us]").astype("int64") / 1e6).tolist(), rows["doc"].tolist(), strict=True):
            while held and held[0][0] < t - span:
                known.discard(held.popleft()[1])
            fresh.append(doc not in known)
            if fresh[-1]:
                held.append((t, doc))
                known.add(doc)
            if len(held) > cap:
                known.discard(held.popleft()[1])
        state.update(([t for t, _ in held], [doc for _, doc in held]))
        if expire:
            state.setTimeoutDuration(int(span * 1000) + 1)
        yield rows[fresh][["kind", "obs_id", "doc", "ts"]]

    return observations.select("kind", "obs_id", "doc", "ts").groupBy("kind").applyInPandasWithState(run, "kind string, obs_id long, doc long, ts timestamp_ntz", "times array<double>, docs array<long>", "append", TIMEOUT[expire])


def leases_stream(events: DataFrame, lease_seconds: float = 60, expire: bool = False) -> DataFrame:
    """[J3] job_id, owner, event_id, outcome of claim, heartbeat and finish events: a lease is held until lease_seconds after its last beat."""

    def run(key: tuple, groups: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:  # nobody has beaten for the whole lease
            return state.remove()
        rows = pd.concat(list(groups)).sort_values(["ts", "event_id"])
        owner, until = state.get if state.exists else ("", 0.0)
        out = []
        for t, who, what in zip((rows["ts"].to_numpy().astype("datetime64[us]").astype("int64") / 1e6).tolist(), rows["owner"], rows["action"], strict=True):
            if owner and until < t:
                owner = ""
            if what == "claim":
                out.append("claimed" if not owner else "busy")
                owner, until = (who, t + lease_seconds) if not owner else (owner, until)
            elif owner == who:
                out.append("extended" if what == "heartbeat" else "finished")
                owner, until = (who, t + lease_seconds) if what == "heartbeat" else ("", 0.0)
            else:
                out.append("lost")
        state.update((owner, until))
        if expire:
            state.setTimeoutDuration(int(lease_seconds * 1000) + 1)
        yield rows.assign(outcome=out)[["job_id", "owner", "event_id", "outcome"]]

    return events.select("job_id", "event_id", "ts", "owner", "action").groupBy("job_id").applyInPandasWithState(run, "job_id long, owner string, event_id long, outcome string", "owner string, until double", "append", TIMEOUT[expire])


def windowed_evidence(observations: DataFrame, late: str = "1 day", width: str = "30 days", slide: str = "1 day") -> DataFrame:
    """[J1] Counts of observations and failures for each kind in sliding windows, with a watermark for late rows."""
    timed = observations.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", width, slide), "kind").agg(F.count("*").alias("documents"), F.sum(F.size("failures")).alias("failures"))


def run_to_end(stream: DataFrame, name: str) -> DataFrame:
    """Runs a stream over all rows that are there into a table in the shared folder, with its checkpoint beside it; returns the table."""
    spark = stream.sparkSession
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        folder = "file://" + tempfile.mkdtemp(prefix="quill-")
    place = f"{folder.rstrip('/')}/quill/{name}-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("path", f"{place}/rows").option("checkpointLocation", f"{place}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/rows")
