"""Learning from decisions as they come: each is predicted from those before it, then learned.

A decision (doc_id, ts, approved, key, tags) is split into units: its key, and each of its tags. A unit's counts are
state of their own, so units run in parallel; a unit with many decisions is one row of state and a stream of rows.
The prediction joins a decision's units again: 0.6 of the key's rate and 0.4 of the mean rate of the tags seen before.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from corpusloom.sources import tables
from corpusloom.streaming.sinks import Step

#: The share of the key's rate in a prediction, and the decisions drawn towards one half.
KEY_SHARE, SMOOTH = 0.6, 2.0
UNIT = "doc_id bigint, unit string, is_key boolean, approved int, seen bigint, rate double"


def units(decisions: DataFrame) -> DataFrame:
    """(doc_id, ts, approved, unit, is_key): a row for the key and one for each different tag."""
    tags = F.transform(F.array_distinct(F.filter(F.coalesce("tags", F.array().cast("array<string>")), lambda t: t.isNotNull())), lambda t: F.struct(F.concat(F.lit("tag:"), t).alias("unit"), F.lit(False).alias("is_key")))
    all_ = F.concat(F.array(F.struct(F.concat(F.lit("key:"), "key").alias("unit"), F.lit(True).alias("is_key"))), tags)
    return decisions.select("doc_id", "ts", F.col("approved").cast("int").alias("approved"), F.explode(all_).alias("x")).select("doc_id", "ts", "approved", "x.*")


class Counts(StatefulProcessor):
    """Counts of one unit; with `keep` milliseconds, a unit that is silent for so long is forgotten."""

    def __init__(self, keep: int | None):
        self.keep = keep

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("counts", "approved long, total long, last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        approved, total, last = self.state.get() if self.state.exists() else (0, 0, 0)
        p = pd.concat(list(rows)).sort_values(["ts", "doc_id"])
        a = p["approved"].cumsum() - p["approved"] + approved
        seen = pd.Series(range(total, total + len(p)), index=p.index, dtype="int64")
        yield pd.DataFrame({"doc_id": p["doc_id"], "unit": key[0], "is_key": p["is_key"], "approved": p["approved"], "seen": seen, "rate": (a + SMOOTH * 0.5) / (seen + SMOOTH)})
        last = max(last, int(p["ts"].max().timestamp() * 1000))
        self.state.update((int(approved + p["approved"].sum()), int(total + len(p)), last))
        if self.keep is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(last + self.keep)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield pd.DataFrame({"doc_id": pd.Series(dtype="int64"), "unit": pd.Series(dtype="object"), "is_key": pd.Series(dtype="bool"), "approved": pd.Series(dtype="int32"), "seen": pd.Series(dtype="int64"), "rate": pd.Series(dtype="float64")})

    def close(self) -> None:
        pass


def learned(decisions: DataFrame, late: str = "10 minutes", keep: int | None = None) -> DataFrame:
    """UNIT rows of a stream: what each unit of a decision had taught before it. Rows of a micro-batch go in event time.

    The session needs the RocksDB state store.
    """
    rows = units(decisions.withWatermark("ts", late))
    return rows.groupBy("unit").transformWithStateInPandas(Counts(keep), UNIT, "Append", "None" if keep is None else "EventTime")


def learned_batch(decisions: DataFrame) -> DataFrame:
    """UNIT rows of a table, by running sums over each unit in order of time."""
    w = Window.partitionBy("unit").orderBy("ts", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    seen, a = F.count("*").over(w), F.coalesce(F.sum("approved").over(w), F.lit(0))
    return units(decisions).select("doc_id", "unit", "is_key", "approved", seen.alias("seen"), ((a + SMOOTH * 0.5) / (seen + SMOOTH)).alias("rate"))


def predicted(rows: DataFrame, warm: int = 4) -> DataFrame:
    """(doc_id, approved, p, ready) of decisions by their UNIT rows; ready if the key had `warm` decisions before."""
    sums = rows.groupBy("doc_id").agg(
        F.max("approved").alias("approved"), F.max(F.when(F.col("is_key"), F.col("rate"))).alias("key_rate"), F.max(F.when(F.col("is_key"), F.col("seen"))).alias("seen"),
        F.avg(F.when(~F.col("is_key") & (F.col("seen") > 0), F.col("rate"))).alias("tag_rate"),
    )
    p = F.when(F.col("tag_rate").isNull(), F.col("key_rate")).otherwise(KEY_SHARE * F.col("key_rate") + (1 - KEY_SHARE) * F.col("tag_rate"))
    return sums.select("doc_id", "approved", F.round(p, 4).alias("p"), (F.col("seen") >= warm).alias("ready"))


def prediction_sink(path: str) -> Step:
    """Keeps predictions by decision; all units of a decision come in one batch, as they are split from one row."""

    def step(batch: DataFrame, number: int) -> None:
        tables.upsert(predicted(batch), ["doc_id"], path, batch=number)

    return step
