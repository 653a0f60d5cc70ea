"""States of jobs from their events: the last state as a batch, and as a stream that forgets jobs in time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import job_results

TTL_MINUTES = 30
#: Event, state of the job after it, progress.
STATES = (("created", "recebido", 0.0), ("started", "processando", 0.0), ("extracted", "processando", 0.5), ("done", "pronto", 1.0), ("failed", "erro", None))


def _after(event: Column, place: int) -> Column:
    return F.element_at(F.create_map(*(x for s in STATES for x in (F.lit(s[0]), F.lit(s[place]).cast("double" if place == 2 else "string")))), event)


def states(events: DataFrame, ttl_minutes: int = TTL_MINUTES) -> DataFrame:
    """id, status, progresso and expira_em of each job, from events (id, ts, seq, event).

    A job that was deleted is gone, whatever comes after. The last event by (ts, seq) gives the state;
    the time to live runs from the first. One aggregation with partial sums, no sort.
    """
    last = events.groupBy("id").agg(
        F.max_by("event", F.struct("ts", "seq")).alias("event"), F.min("ts").alias("_first"), F.max(F.col("event") == "deleted").alias("_gone")
    )
    alive = last.where(~F.col("_gone"))
    return alive.select("id", _after(F.col("event"), 1).alias("status"), _after(F.col("event"), 2).alias("progresso"), (F.col("_first") + F.expr(f"INTERVAL {ttl_minutes} MINUTES")).alias("expira_em"))


def expired(jobs: DataFrame, as_of: Column) -> DataFrame:
    """Jobs whose time is over; names that are no job ids are left alone."""
    return jobs.where((F.col("expira_em") <= as_of) & F.col("id").cast("string").rlike(r"^[0-9a-f]{32}\z"))


def alive(jobs: DataFrame, as_of: Column) -> DataFrame:
    return jobs.where(F.col("expira_em") > as_of)


def still_wanted(queued: DataFrame, jobs: DataFrame) -> DataFrame:
    """Queued work whose job has not been cancelled meanwhile."""
    return queued.join(jobs.select("id"), "id", "left_semi")


STATE = "first timestamp, ts timestamp, seq bigint, event string"


def follow(events: DataFrame, ttl_minutes: int = TTL_MINUTES) -> DataFrame:
    """The same over a stream with a watermark on ``ts``: a row whenever a job's state changes.

    A job that is deleted gives a row with status ``apagado``; what is kept of it until its time is over
    is a tombstone, so that a later event does not bring it back. When its time is over a job that is
    still there gives a row with status ``expirado``, after which nothing is kept of it.
    """
    after = {e: (status, progress) for e, status, progress in STATES}
    ttl = pd.Timedelta(minutes=ttl_minutes)
    output = f"id {dict(events.dtypes)['id']}, status string, progresso double, expira_em timestamp"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        def row(status: str, progress: float | None, until: pd.Timestamp) -> pd.DataFrame:
            return pd.DataFrame({"id": [key[0]], "status": [status], "progresso": pd.Series([progress], dtype="float64"), "expira_em": [until]})

        if state.hasTimedOut:
            first, _, _, event = state.get
            state.remove()
            if event != "deleted":
                yield row("expirado", None, pd.Timestamp(first) + ttl)
            return
        known = state.get if state.exists else None
        new = pd.concat(list(batches))
        first = min([new["ts"].min(), *([pd.Timestamp(known[0])] if known else [])])
        until = first + ttl
        gone = known is not None and known[3] == "deleted"
        last = new.sort_values(["ts", "seq"]).iloc[-1]
        ts, seq, event = last["ts"], int(last["seq"]), last["event"]
        if gone or (new["event"] == "deleted").any():
            event = "deleted"
        elif known and (pd.Timestamp(known[1]), known[2]) > (ts, seq):
            ts, seq, event = pd.Timestamp(known[1]), known[2], known[3]
        state.update((first.to_pydatetime(), ts.to_pydatetime(), seq, event))
        state.setTimeoutTimestamp(max(int(until.timestamp() * 1000), state.getCurrentWatermarkMs() + 1))
        if event != "deleted":
            yield row(*after[event], until)
        elif not gone:
            yield row("apagado", None, until)

    return events.groupBy("id").applyInPandasWithState(step, output, STATE, "update", "EventTimeTimeout")


def results(pages: DataFrame, jobs: DataFrame) -> DataFrame:
    """id and ``resultado``: the result of each job that is done, as one JSON text with its pages and their entities.

    ``pages``: id, numero, largura, altura, entidades (an array of structs); a page without entities has
    an empty list. Only the pages of one job come together.
    """
    page = F.struct("numero", "largura", "altura", F.coalesce("entidades", F.array()).alias("entidades"))
    grouped = pages.groupBy("id").agg(F.array_sort(F.collect_list(page), lambda a, b: F.when(a["numero"] < b["numero"], -1).when(a["numero"] > b["numero"], 1).otherwise(0)).alias("paginas"))
    done = grouped.join(jobs.where("status = 'pronto'").select("id"), "id", "left_semi")
    return done.select("id", F.to_json(F.struct("paginas")).alias("resultado"))


def write_results(results_: DataFrame, path: str) -> None:
    """A document for each job, all of a run or none; earlier runs stay (``sources.job_results``)."""
    job_results.register(results_.sparkSession)
    results_.select(F.col("id").cast("string").alias("id"), "resultado").write.format("job_results").mode("append").save(path)
