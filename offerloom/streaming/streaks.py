"""Failure streaks kept as state over a stream of audit results."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from offerloom import rules

cloudpickle.register_pickle_by_value(sys.modules[__name__])

OUTPUT = "retailer_id string, run_at timestamp, pass boolean, consecutive_failures long, auto_disabled boolean"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Streaks(StatefulProcessor):
    """The state of a source is its current streak; it may be given before the first run."""

    def __init__(self, disable_after: int):
        self.disable_after = disable_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.streak = handle.getValueState("streak", "failures long")

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        self.streak.update((int(initialState["failures"].max()),))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """Runs of one source in time order.  A source has one result per run, so a micro-batch holds few of them."""
        streak = self.streak.get()[0] if self.streak.exists() else 0
        runs = pd.concat(list(rows)).sort_values("run_at", kind="stable")
        streaks = []
        for ok in runs["passed"]:
            streak = 0 if ok else streak + 1
            streaks.append(streak)
        self.streak.update((streak,))
        yield pd.DataFrame(
            {
                "retailer_id": key[0],
                "run_at": runs["run_at"].to_numpy(),
                "pass": runs["passed"].to_numpy(),
                "consecutive_failures": streaks,
                "auto_disabled": [s >= self.disable_after for s in streaks],
            }
        )

    def close(self) -> None:
        pass


def use_state_store(spark: SparkSession) -> None:
    """Keyed state with initial values needs the RocksDB store; a session that names a store keeps it."""
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider"):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def stream_streaks(results: DataFrame, state: DataFrame | None = None, disable_after: int = rules.DISABLE_AFTER) -> DataFrame:
    """Streak after every run; ``results``: retailer_id, run_at, pass (a stream).

    ``state``: scope, retailer_id, failures, as the batch audit writes it.  It counts when the stream is started for
    the first time; later the stream's own checkpoint holds the streaks.  A source without state begins at 0, one
    without runs keeps its streak.
    """
    use_state_store(results.sparkSession)
    known = None
    if state is not None:
        # One row a source: the audit table has no more, and equal keys would be handed over one by one.
        sources = state.where("scope = 'retailer'").groupBy("retailer_id").agg(F.max("failures").cast("long").alias("failures"))
        known = sources.groupBy("retailer_id")
    rows = results.select("retailer_id", "run_at", F.coalesce("pass", F.lit(False)).alias("passed"))
    return rows.groupBy("retailer_id").transformWithStateInPandas(Streaks(disable_after), OUTPUT, "Append", "None", known)
