"""Calibration and classifiers with pyspark.ml."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixspark.operators import evaluation as E
from helixspark.operators import variants as V
from helixspark.sources import tables as T


def logit(score: str) -> Column:
    s = F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), F.col(score)))
    return F.log(s / (1 - s))


def calibrated(scored: DataFrame, fit: Column) -> DataFrame:
    """Adds `platt` (a logistic fit on log-odds) and `isotonic`, both fitted on the rows where `fit` holds."""
    rows = VectorAssembler(inputCols=["_logit"], outputCol="_x").transform(scored.withColumn("_logit", logit("score")))
    train = rows.where(fit)
    platt = LogisticRegression(featuresCol="_x", labelCol="label", predictionCol="_p", rawPredictionCol="_r", probabilityCol="_prob").fit(train)
    one_dim = VectorAssembler(inputCols=["score"], outputCol="_s")
    isotonic = IsotonicRegression(featuresCol="_s", labelCol="label", predictionCol="isotonic").fit(one_dim.transform(train))
    out = isotonic.transform(one_dim.transform(platt.transform(rows)))
    return out.withColumn("platt", vector_to_array("_prob")[1]).drop("_logit", "_x", "_p", "_r", "_prob", "_s")


def classifiers(n_features: int, seed: int = 42, trees: int = 20, rounds: int = 10, hidden: tuple[int, ...] = (16,)) -> dict:
    """The base models by name; sizes are parameters."""
    return {
        "logistic": LogisticRegression(featuresCol="features", labelCol="label", regParam=0.01),
        "forest": RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=trees, maxDepth=6, seed=seed),
        "boosted": GBTClassifier(featuresCol="features", labelCol="label", maxIter=rounds, maxDepth=4, seed=seed),
        "svm": LinearSVC(featuresCol="features", labelCol="label", regParam=0.01, maxIter=50),
        "network": MultilayerPerceptronClassifier(featuresCol="features", labelCol="label", layers=[n_features, *hidden, 2], maxIter=50, seed=seed),
    }


#: Weighted rows are fitted in pieces of at most a 2 ** -20 share of all rows, so that samples of the pieces are as good as samples of rows.
PIECES = 1 << 20


def _scaled(rows: DataFrame, features: list[str], fit: Column, weight: str) -> DataFrame:
    """`features`: the vector of features less the mean and by the sample deviation of all rows where `fit` holds, of which each row here
    stands for `weight`; 0 for a feature that is constant there."""
    train, w = rows.where(fit), F.col(weight)
    mean = train.agg(F.sum(w).alias("n"), *[(F.sum(w * F.col(c)) / F.sum(w)).alias(c) for c in features]).first()
    spread = train.agg(*[F.sqrt(F.sum(w * F.pow(F.col(c) - mean[c], F.lit(2))) / (F.sum(w) - 1)).alias(c) for c in features]).first()
    scaled = rows.select("*", *[((F.col(c) - mean[c]) / spread[c] if spread[c] else F.lit(0.0)).alias(f"_scaled_{c}") for c in features])
    names = [f"_scaled_{c}" for c in features]
    return VectorAssembler(inputCols=names, outputCol="features").transform(scaled).drop(*names)


def pieces(rows: DataFrame, weight: str, most: int = PIECES) -> DataFrame:
    """The rows in pieces: each has a part of its row's weight, at most a `most`-th of all weights (rounded up); all weight is kept."""
    total = rows.agg(F.sum(weight)).first()[0] or 0
    size = max(1, -(-total // most))
    cut = rows.withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col(weight) / size) - 1)))
    return cut.withColumn(weight, F.least(F.lit(size), F.col(weight) - F.col("_piece") * size)).drop("_piece")


def _rows_of(train: DataFrame, weight: str, per_task: int = 1_000_000) -> DataFrame:
    """Every row by itself, for models that know no weights, in tasks of about as many rows each."""
    total = train.agg(F.sum(weight)).first()[0] or 0
    dealt = train.repartition(max(train.sparkSession.sparkContext.defaultParallelism, total // per_task))
    return dealt.select("label", "features", F.explode(F.sequence(F.lit(1).cast("long"), F.col(weight)))).drop("col")


def scored_by(models: dict, rows: DataFrame, features: list[str], fit: Column, weight: str | None = None) -> DataFrame:
    """Adds a probability column a model, fitted on the rows where `fit` holds, over features scaled by those rows. A model that only has
    margins gets its probabilities by a logistic fit on the training rows' margins. With `weight`, a column of whole numbers, a row stands for
    as many rows that are alike.

    A fit passes over its rows many times, so the rows and the training rows' scaled vectors are made once and written.
    """
    rows = T.staged(rows, "features")
    if weight:
        out = _scaled(rows, features, fit, weight)
        cut = pieces(out.where(fit).select("label", "features", weight), weight)
        train = T.staged(cut.repartition(rows.sparkSession.sparkContext.defaultParallelism), "train")
    else:
        raw = VectorAssembler(inputCols=features, outputCol="_raw").transform(rows)
        out = StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True).fit(raw.where(fit)).transform(raw).drop("_raw")
        train = T.staged(out.where(fit).select("label", "features"), "train")

    def fitted(model, on: DataFrame):  # noqa: ANN001, ANN202
        if not weight:
            return model.fit(on)
        return model.setWeightCol(weight).fit(on) if model.hasParam("weightCol") else model.fit(_rows_of(on, weight))

    for name, model in models.items():
        model = model.setPredictionCol("_p").setRawPredictionCol("_r")
        if model.hasParam("probabilityCol"):
            out = fitted(model.setProbabilityCol("_q"), train).transform(out)
        else:
            margin, vector = fitted(model, train), VectorAssembler(inputCols=["_m"], outputCol="_v")
            margins = lambda df: vector.transform(margin.transform(df).withColumn("_m", vector_to_array("_r")[1]))  # noqa: E731, B023
            platt = fitted(LogisticRegression(featuresCol="_v", labelCol="label", predictionCol="_p2", rawPredictionCol="_r2", probabilityCol="_q"), margins(train))
            out = platt.transform(margins(out)).drop("_m", "_v", "_p2", "_r2")
        out = out.withColumn(name, vector_to_array("_q")[1]).drop("_p", "_r", "_q")
    return out.drop("features")


def grid_search(rows: DataFrame, features: list[str], fit: Column, validation: Column, depths: tuple[int, ...] = (2, 4), rounds: tuple[int, ...] = (5, 10), steps: tuple[float, ...] = (0.1,), seed: int = 42, weight: str | None = None) -> DataFrame:
    """Boosted trees over a grid, fitted where `fit` holds, with their metrics where `validation` holds; the best AUROC comes first."""
    grid = {
        f"depth{d}_rounds{r}_step{s}": GBTClassifier(featuresCol="features", labelCol="label", maxDepth=d, maxIter=r, stepSize=s, subsamplingRate=0.8, seed=seed)
        for d in depths for r in rounds for s in steps
    }
    kept = ["label", *([weight] if weight else [])]
    scored = scored_by(grid, rows, features, fit, weight).where(validation).select(*kept, *[f"`{g}`" for g in grid])
    long = T.staged(scored, "scores").unpivot(kept, [F.col(f"`{g}`") for g in grid], "model", "score")
    return V.score_metrics(long, ["model"], weight).orderBy(F.desc_nulls_last("auroc"), "model")


def stacked(rows: DataFrame, features: list[str], fit: Column, key: Column, k: int = 3) -> DataFrame:
    """Base models' out-of-fold scores train a logistic model over them (`stack`); all rows where `fit` doesn't hold get whole-train base scores."""
    models = classifiers(len(features))
    dealt = E.folds(rows, key, k)
    oof = None
    for i in range(k):
        part = scored_by(models, dealt.where(fit), features, F.col("fold") != i).where(F.col("fold") == i)
        oof = part if oof is None else oof.unionByName(part)
    rest = scored_by(models, dealt, features, fit).where(~fit)
    both = oof.withColumn("_oof", F.lit(True)).unionByName(rest.withColumn("_oof", F.lit(False)))
    meta = LogisticRegression(featuresCol="features", labelCol="label", regParam=0.01)
    return scored_by({"stack": meta}, both, list(models), F.col("_oof")).drop("_oof", "fold")
