"""Models fitted in walk-forward folds: each fold trains on what is before it, calibrates on the last part of that, and is scored on its own rows."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.operators.estimation import temperature


def fitted_folds(folds: DataFrame, features: list[str], label: str, classes: int = 3, side_by_side: int = 4) -> DataFrame:
    """fold, match_id, label and probabilities (raw and calibrated) of each fold's validation rows.

    ``folds`` has fold, part (train, calibrate, validate), match_id, features and ``label`` (0, 1, ...). The model is Spark's multinomial
    logistic; its temperature minimises the log-loss of the fold's calibration rows. Folds are fitted side by side, each on
    its own rows of the kept table. Rows with a null feature or label teach nothing; a null feature is scored as 0."""
    x = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features]
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*features, label]])
    rows = folds.select("fold", "part", "match_id", F.col(label).cast("double").alias("label"), known.alias("_known"), *x)
    rows = VectorAssembler(inputCols=features, outputCol="_x").transform(rows).select("fold", "part", "match_id", "label", "_known", "_x").persist()
    names = [f"_p{k}" for k in range(classes)]
    numbers = sorted(r.fold for r in rows.select("fold").distinct().collect())  # a number for each fold

    def one(fold: int) -> DataFrame:
        own = rows.where(F.col("fold") == fold)
        model = LogisticRegression(featuresCol="_x", labelCol="label", probabilityCol="_q", maxIter=100, tol=1e-9, family="multinomial").fit(own.where("part = 'train' and _known"))
        spread = lambda df: model.transform(df).select("fold", "match_id", "label", *[F.get(vector_to_array("_q"), F.lit(k)).alias(n) for k, n in enumerate(names)])
        heat = temperature(spread(own.where("part = 'calibrate' and _known")), names, "label")
        made = spread(own.where("part = 'validate'"))
        return made.select("fold", "match_id", "label", F.array(*names).alias("raw"), F.array(*[F.pow(n, F.lit(1 / heat)) for n in names]).alias("_h"), F.lit(heat).alias("temperature"))

    with ThreadPoolExecutor(side_by_side) as pool:
        made = reduce(DataFrame.unionByName, pool.map(one, numbers))
    total = F.aggregate("_h", F.lit(0.0), lambda t, p: t + p)
    return made.select("fold", "match_id", "label", "raw", F.transform("_h", lambda p: p / total).alias("calibrated"), "temperature")


def fold_report(scored: DataFrame, classes: int = 3) -> DataFrame:
    """fold, model (raw, calibrated), n, temperature, log-loss, Brier score and accuracy."""
    long = scored.where("label is not null").select("fold", "label", "temperature", F.inline(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("p")) for m in ("raw", "calibrated")])))
    own = F.get("p", F.col("label").cast("int"))
    brier = sum(((F.get("p", F.lit(k)) - (F.col("label") == k).cast("double")) ** 2 for k in range(classes)), F.lit(0.0))
    return long.groupBy("fold", "model").agg(F.count("*").alias("n"), F.first("temperature").alias("temperature"), F.avg(-F.ln(F.greatest(own, F.lit(1e-15)))).alias("log_loss"), F.avg(brier).alias("brier"), F.avg((F.array_position("p", F.array_max("p")) - 1 == F.col("label")).cast("double")).alias("accuracy"))
