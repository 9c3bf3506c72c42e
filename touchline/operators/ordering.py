"""Exact row numbers over a whole table, and what is built on them: ids in first-seen order, codes, folds by row number."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the folder that ``spark.checkpoint.dir`` names; where that is unset, a local master (tests) gets a local one."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        base = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not base and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(base or "file://" + tempfile.mkdtemp(prefix="spark-touchline-"))
    return df.checkpoint()


def row_numbers(df: DataFrame, order: list[Column], out: str = "row") -> DataFrame:
    """``df`` with ``out``, each row's number from 0 in the order of the whole table.

    Rows are dealt by range and sorted within partitions, which are kept (a second run could deal otherwise); a partition's offset is the
    sum of those before it, a row for each partition. No task sees more than its range. ``order`` should leave no ties."""
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    starts = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row for each partition
    return placed.join(starts, part == F.col("_part")).select(*[F.col(f"`{c}`") for c in df.columns if c != out], (F.col("_before") + within).alias(out))


def first_seen_ids(df: DataFrame, keys: list[str], order: list[str], base: int = 1) -> DataFrame:
    """``keys`` and id, from ``base`` on, in the order in which they are first seen in ``df`` (by ``order``)."""
    firsts = df.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_first"))
    made = row_numbers(firsts, [F.col("_first"), *[F.col(k) for k in keys]], "id")
    return made.select(*keys, (F.col("id") + base).alias("id"))


def row_folds(numbered: DataFrame, train: int, test: int, step: int, row: str = "row") -> DataFrame:
    """fold, part and the rows' columns: fold k trains on the rows k * ``step`` to k * ``step`` + ``train`` and tests on the next ``test``;
    only folds that are full. A row is in (train + test) / step folds at most."""
    total = numbered.agg((F.max(row) + 1).alias("_total"))  # one row
    last = F.floor((F.col("_total") - train - test) / step)
    own = F.col(row)
    low = F.greatest(F.floor((own - train - test) / step) + 1, F.lit(0))
    high = F.least(F.floor(own / step), last)
    made = numbered.join(total, F.lit(True)).where(low <= high).withColumn("fold", F.explode(F.sequence(low, high)))
    return made.withColumn("part", F.when(own - F.col("fold") * step < train, "train").otherwise("test")).select("fold", "part", *numbered.columns)


def season_folds(df: DataFrame, first: int, last: int, window: int | None = None, season: str = "season") -> DataFrame:
    """fold (a season), part and the rows' columns: a season tests what the seasons before it train, the ``window`` last of them if given."""
    own = F.col(season)
    low, high = F.greatest(own, F.lit(first)), F.least(own + window, F.lit(last)) if window else F.lit(last)
    made = df.where(low <= high).withColumn("fold", F.explode(F.sequence(low.cast("int"), high.cast("int"))))
    return made.withColumn("part", F.when(own == F.col("fold"), "test").otherwise("train")).select("fold", "part", *df.columns)
