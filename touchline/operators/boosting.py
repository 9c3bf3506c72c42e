"""Boosted results and goals: Spark's regression trees as weak learners on the slope and curvature of a softmax or Poisson log-likelihood."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.operators.ordering import cut


@dataclass(frozen=True)
class Boosting:
    """``softmax`` over ``classes`` (labels 0, 1, ...) or ``poisson`` counts; class weights by label; each seed grows its own trees on its own
    draws of rows, and the seeds' outputs are averaged."""

    kind: str = "softmax"
    classes: int = 3
    rounds: int = 10
    depth: int = 3
    rate: float = 0.3
    subsample: float = 0.8
    least: int = 20
    weights: tuple[float, ...] | None = None
    seeds: tuple[int, ...] = (7,)


@dataclass
class Boosted:
    """Where the outputs start, and per seed the trees of every round (one for each class, or one)."""

    plan: Boosting
    features: list[str]
    start: list[float]
    trees: list[list[list[DecisionTreeRegressionModel]]] = field(default_factory=list)


def _assembled(df: DataFrame, features: list[str]) -> DataFrame:
    made = df.withColumns({f"_f{k}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for k, c in enumerate(features)})
    return VectorAssembler(inputCols=[f"_f{k}" for k in range(len(features))], outputCol="_x").transform(made).drop(*[f"_f{k}" for k in range(len(features))])


def _shares(margins: list[Column]) -> list[Column]:
    top = F.greatest(*margins)
    parts = [F.exp(m - top) for m in margins]
    return [p / reduce(lambda a, b: a + b, parts) for p in parts]


def boosted(train: DataFrame, features: list[str], label: str, plan: Boosting = Boosting()) -> Boosted:
    """Grows the trees. A tree is fitted by weighted least squares to slope / curvature of the log-likelihood at the present
    outputs, so its leaves are Newton steps. Rows with a null label teach nothing; a null feature counts as 0."""
    k = plan.classes if plan.kind == "softmax" else 1
    rows = _assembled(train.where(F.col(label).isNotNull()), features).select(F.col(label).cast("double").alias("_y"), "_x")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in plan.weights]), F.col("_y").cast("int") + 1) if plan.weights else F.lit(1.0)
    rows = rows.withColumn("_w", weight).persist()
    if plan.kind == "softmax":
        shares = rows.agg(*[F.sum(F.when(F.col("_y") == c, F.col("_w")).otherwise(0.0)).alias(f"c{c}") for c in range(k)], F.sum("_w").alias("n")).select(*[F.ln(F.greatest(F.col(f"c{c}") / F.col("n"), F.lit(1e-6))).alias(f"c{c}") for c in range(k)])
    else:
        shares = rows.agg(F.ln(F.greatest(F.sum(F.col("_y") * F.col("_w")) / F.sum("_w"), F.lit(1e-6))).alias("c0"))
    made = Boosted(plan, list(features), [float(x) for x in shares.first()])
    for seed in plan.seeds:
        state = rows.withColumns({f"_m{c}": F.lit(x) for c, x in enumerate(made.start)})
        grown = []
        for turn in range(plan.rounds):
            margins = [F.col(f"_m{c}") for c in range(k)]
            mean = _shares(margins) if plan.kind == "softmax" else [F.exp(F.least(margins[0], F.lit(5.0)))]
            drawn = state.sample(plan.subsample, seed * 1000 + turn) if plan.subsample < 1 else state
            trees = []
            for c in range(k):
                bend = F.greatest(mean[c] * (1 - mean[c]) if plan.kind == "softmax" else mean[c], F.lit(1e-3))
                slope = ((F.col("_y") == c).cast("double") if plan.kind == "softmax" else F.col("_y")) - mean[c]
                step = F.greatest(F.least(slope / bend, F.lit(4.0)), F.lit(-4.0))
                trees.append(DecisionTreeRegressor(featuresCol="_x", labelCol="_z", weightCol="_v", maxDepth=plan.depth, minInstancesPerNode=plan.least, seed=seed).fit(drawn.select("_x", step.alias("_z"), (F.col("_w") * bend).alias("_v"))))
            grown.append(trees)
            state = cut(_moved(state, trees, plan))  # else a round would work out all trees before it again
        made.trees.append(grown)
    rows.unpersist()
    return made


def _moved(df: DataFrame, trees: list[DecisionTreeRegressionModel], plan: Boosting) -> DataFrame:
    for c, tree in enumerate(trees):
        df = tree.setPredictionCol(f"_t{c}").transform(df)
    df = df.withColumns({f"_m{c}": F.col(f"_m{c}") + plan.rate * F.col(f"_t{c}") for c in range(len(trees))})
    return df.drop(*[f"_t{c}" for c in range(len(trees))])


def boosted_scores(df: DataFrame, model: Boosted, out: str = "probabilities") -> DataFrame:
    """``df`` with ``out``: an array of class probabilities, or the expected count; means over the seeds."""
    plan, k, means = model.plan, len(model.start), []
    made = _assembled(df, model.features)
    for s, grown in enumerate(model.trees):
        made = made.withColumns({f"_m{c}": F.lit(x) for c, x in enumerate(model.start)})
        for trees in grown:
            made = _moved(made, trees, plan)
        margins = [F.col(f"_m{c}") for c in range(k)]
        own = F.array(*_shares(margins)) if plan.kind == "softmax" else F.exp(F.least(margins[0], F.lit(5.0)))
        made = made.withColumn(f"_s{s}", own).drop(*[f"_m{c}" for c in range(k)])
        means.append(F.col(f"_s{s}"))
    n = float(len(means))
    value = F.array(*[reduce(lambda a, b: a + b, [F.get(m, F.lit(c)) for m in means]) / n for c in range(k)]) if plan.kind == "softmax" else reduce(lambda a, b: a + b, means) / n
    return made.select(*[F.col(f"`{c}`") for c in df.columns if c != out], value.alias(out))
