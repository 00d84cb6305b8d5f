"""Stateful operators over unbounded inputs; each has a batch twin in lectern.operators.ledgers or .sync."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def lag_rollup(events: DataFrame, at: str, value: str, threshold: float, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Largest value, values above the threshold and samples per window; rows later than the watermark are dropped."""
    return (
        events.withWatermark(at, late).groupBy(F.window(at, window))
        .agg(F.max(value).alias("largest"), F.count_if(F.col(value) > threshold).alias("over"), F.count("*").alias("samples"))
        .select(F.col("window.start").alias("start"), "largest", "over", "samples")
    )


def breaker(events: DataFrame, key: str, threshold: int = 30, window: float = 300.0, cooldown: float = 600.0) -> DataFrame:
    """The sliding-window breaker on a stream of (key, seq, at in seconds, failed): a state for each event.

    State per key: phase, end of the cooldown, and the failure times inside the window, fewer than
    the threshold. Events of a key inside a micro-batch are taken in order of (at, seq).
    """
    kind = events.schema[key].dataType.simpleString()

    def run(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        phase, until, recent = state.get if state.exists else ("CLOSED", 0.0, [])
        recent = list(recent)
        rows = pd.concat(list(batches)).sort_values(["at", "seq"])
        out = []
        for at, failed in zip(rows["at"], rows["failed"], strict=True):
            if phase == "OPEN" and at >= until:
                phase = "HALF_OPEN"
            if phase == "HALF_OPEN":
                phase, until, recent = ("OPEN", at + cooldown, []) if failed else ("CLOSED", 0.0, [])
            elif phase == "CLOSED" and failed:
                recent = [x for x in recent if x >= at - window] + [at]
                if len(recent) >= threshold:
                    phase, until, recent = "OPEN", at + cooldown, []
            out.append(phase)
        state.update((phase, float(until), [float(x) for x in recent]))
        yield pd.DataFrame({key: name[0], "seq": rows["seq"], "state": out})

    return events.groupBy(key).applyInPandasWithState(run, f"`{key}` {kind}, seq long, state string", "phase string, until double, recent array<double>", "append", GroupStateTimeout.NoTimeout)


def attempts(events: DataFrame, limit: int = 3) -> DataFrame:
    """The attempt machine on a stream of (key, seq, status, fingerprint): attempts and effective status after each event."""
    success = ("done", "done_meta", "done_abstract")
    kind = events.schema["key"].dataType.simpleString()

    def run(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, known = state.get if state.exists else (0, None)
        out = []
        rows = pd.concat(list(batches)).sort_values("seq")
        for status, fp in zip(rows["status"], rows["fingerprint"], strict=True):
            fp = None if pd.isna(fp) else fp
            if status == "error":
                n += 1
                status = "error_parked" if 0 < limit <= n else "error"
            elif status in success or fp is not None and fp != known:
                n = 0
            known = fp if fp is not None else known
            out.append((n, status))
        state.update((n, known))
        yield pd.DataFrame({"key": name[0], "seq": rows["seq"], "attempts": [a for a, _ in out], "status": [s for _, s in out]})

    return events.groupBy("key").applyInPandasWithState(run, f"key {kind}, seq long, attempts long, status string", "n long, known string", "append", GroupStateTimeout.NoTimeout)


def upsert_latest(spark, path: str, key: str, order: str):
    """A foreachBatch sink that keeps the newest row of each key in Parquet folders path/v<epoch>, newer or equal wins.

    An epoch that is run again writes the same folder again, from the one before it.
    """

    def sink(batch: DataFrame, epoch: int) -> None:
        rest = [c for c in batch.columns if c not in (key, "_new")]
        rows = batch.select(key, *rest, F.lit(1).alias("_new"))
        if epoch > 0:
            rows = rows.unionByName(spark.read.parquet(f"{path}/v{epoch - 1}").select(key, *rest, F.lit(0).alias("_new")))
        newest = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(order, "_new")).alias("r")).select(key, "r.*")
        newest.write.mode("overwrite").parquet(f"{path}/v{epoch}")

    return sink
