"""Keyed state and lifecycles of streams: form from the last rows of a team, predictions settled by results, snapshots that batches upsert once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Rows of a team that the state keeps.
KEEP = 30
ROW = "date timestamp, match_id long, gf double, ga double, pts double"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def team_state(long: DataFrame, keep: int = KEEP) -> DataFrame:
    """The last ``keep`` rows of each team (league, team, date, match_id, gf, ga, pts): what form after them needs."""
    w = W.partitionBy("league", "team").orderBy(F.desc("date"), F.desc("match_id"))
    return long.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= keep).select("league", "team", *_row())


def _row() -> list[Column]:
    return [F.col("date").cast("timestamp").alias("date"), F.col("match_id").cast("long").alias("match_id"), *[F.col(c).cast("double").alias(c) for c in ("gf", "ga", "pts")]]


def advanced(state: DataFrame, delta: DataFrame, widths: tuple[int, ...] = (5, 10)) -> DataFrame:
    """Form of the rows of ``delta`` (means of gf, ga and pts over each team's last rows before them) from ``state`` and ``delta`` alone.

    ``delta`` comes after ``state``, so what was before need not be read again; ``team_state`` of both together is the next state."""
    if max(widths) > KEEP:
        raise ValueError(f"a state of {KEEP} rows cannot give form over {max(widths)}")
    rows = state.withColumn("_new", F.lit(False)).unionByName(delta.select("league", "team", *_row()).withColumn("_new", F.lit(True)))
    w = W.partitionBy("league", "team").orderBy("date", "match_id")
    made = rows.withColumns({f"{c}_{n}": F.avg(c).over(w.rowsBetween(-n, -1)) for n in widths for c in ("gf", "ga", "pts")})
    return made.where("_new").drop("_new", "gf", "ga", "pts")


class FormState(StatefulProcessor):
    """A ring of a team's last rows: each new row gets its form from the ring and then enters it."""

    def __init__(self, widths: tuple[int, ...]):
        self.widths = widths

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getListState("ring", ROW)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803  (Spark's names)
        self.ring.put([self._tuple(r) for r in initialState.sort_values(["date", "match_id"]).itertuples()])

    @staticmethod
    def _tuple(r) -> tuple:
        return pd.Timestamp(r.date).to_pydatetime(), int(r.match_id), float(r.gf), float(r.ga), float(r.pts)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        ring = sorted(tuple(r) for r in self.ring.get())
        out = []
        for r in pd.concat(list(rows)).sort_values(["date", "match_id"]).itertuples():
            form = [sum(x[k] for x in ring[-n:]) / len(ring[-n:]) if ring else None for n in self.widths for k in (2, 3, 4)]
            out.append((key[0], key[1], r.date, int(r.match_id), *form))
            ring = [*ring, self._tuple(r)][-KEEP:]
        self.ring.put(ring)
        names = [f"{c}_{n}" for n in self.widths for c in ("gf", "ga", "pts")]
        yield pd.DataFrame(out, columns=["league", "team", "date", "match_id", *names]).astype(dict.fromkeys(names, float))

    def close(self) -> None:
        pass


def form_stream(stream: DataFrame, state: DataFrame | None = None, widths: tuple[int, ...] = (5, 10)) -> DataFrame:
    """``advanced`` as a stream: a ring of the last rows a team, seeded from ``state``. Rows of a team must come in the order of date
    and match_id from batch to batch; within a batch they are put in order. Needs the RocksDB state store (``ROCKS``)."""
    if max(widths) > KEEP:
        raise ValueError(f"a state of {KEEP} rows cannot give form over {max(widths)}")
    own = stream.select(F.col("league").cast("int").alias("league"), F.col("team").cast("long").alias("team"), *_row())
    schema = "league int, team long, date timestamp, match_id long, " + ", ".join(f"{c}_{n} double" for n in widths for c in ("gf", "ga", "pts"))
    seeds = state.select(F.col("league").cast("int").alias("league"), F.col("team").cast("long").alias("team"), "date", "match_id", "gf", "ga", "pts").groupBy("league", "team") if state is not None else None
    return own.groupBy("league", "team").transformWithStateInPandas(FormState(widths), schema, "Append", "None", seeds)


def lifecycle(predictions: DataFrame, results: DataFrame, wait: str = "3 hours", late: str = "1 hour") -> DataFrame:
    """prediction_id, fixture_id, prediction_time, p_h, p_d, p_a, outcome, log_loss and status of every prediction.

    A prediction (prediction_id, fixture_id, prediction_time, p_h, p_d, p_a) is settled by its fixture's result (fixture_id,
    result_time, home_goals, away_goals) when that comes no more than ``wait`` after it; with none by then, and ``late`` for rows that
    are late themselves, it is given out once as expired. All predictions of a fixture are settled, live ones as well."""
    p = predictions.withWatermark("prediction_time", late) if predictions.isStreaming else predictions
    r = results.select(F.col("fixture_id").alias("_fixture"), "result_time", "home_goals", "away_goals")
    r = r.withWatermark("result_time", late) if results.isStreaming else r
    same = (F.col("fixture_id") == F.col("_fixture")) & (F.col("result_time") >= F.col("prediction_time")) & (F.col("result_time") <= F.col("prediction_time") + F.expr(f"interval {wait}"))
    outcome = F.when(F.col("home_goals") > F.col("away_goals"), "H").when(F.col("home_goals") == F.col("away_goals"), "D").when(F.col("home_goals").isNotNull(), "A")
    own = F.when(outcome == "H", F.col("p_h")).when(outcome == "D", F.col("p_d")).otherwise(F.col("p_a"))
    status = F.when(outcome.isNull(), "expired").otherwise("settled")
    return p.join(r, same, "left_outer").select("prediction_id", "fixture_id", "prediction_time", "p_h", "p_d", "p_a", outcome.alias("outcome"), F.when(outcome.isNotNull(), -F.ln(F.greatest(own, F.lit(1e-15)))).alias("log_loss"), status.alias("status"))


def applied(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the batches that a folder of snapshots holds, in order."""
    try:
        return sorted(r.batch for r in spark.read.schema("batch long").parquet(f"{folder}/batches").distinct().collect())
    except AnalysisException:  # no batch yet
        return []


def snapshot(spark: SparkSession, folder: str) -> DataFrame | None:
    """The table after the last batch, or None before the first."""
    done = applied(spark, folder)
    return spark.read.parquet(f"{folder}/v={done[-1]}") if done else None


def upsert_batch(batch: DataFrame, number: int, folder: str, key: list[str], order: str) -> None:
    """A batch put into a table of snapshots, for ``foreachBatch``: of each key the row of the largest ``order`` stays, of equals the new one.

    A batch writes a snapshot of its own and counts from when its number is in the folder's list. So a batch that is run again after
    a failure starts from the same snapshot as before, and one that was applied changes nothing."""
    spark, done = batch.sparkSession, applied(batch.sparkSession, folder)
    if number in done or (done and number < done[-1]):
        return
    rows = batch.withColumn("_new", F.lit(1))
    if done:
        rows = spark.read.parquet(f"{folder}/v={done[-1]}").withColumn("_new", F.lit(0)).unionByName(rows)
    rest = [c for c in batch.columns if c not in key]
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(order, "_new", *[c for c in rest if c != order])).alias("_r"))
    last.select(*key, "_r.*").select(*batch.columns).write.mode("overwrite").parquet(f"{folder}/v={number}")
    spark.range(1).select(F.lit(number).cast("long").alias("batch")).write.mode("append").parquet(f"{folder}/batches")


def upsert_stream(stream: DataFrame, folder: str, checkpoint: str, key: list[str], order: str):
    """Starts ``upsert_batch`` over a stream."""
    return stream.writeStream.foreachBatch(lambda df, k: upsert_batch(df, k, folder, key, order)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
