"""Jobs that write: the ETL, the saved splits, the drift run, the saved pipeline and its batch scores."""

from __future__ import annotations

from pyspark.ml import Estimator, PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from helixspark.operators import annotate as N
from helixspark.operators import drift as D
from helixspark.operators import preparation as R
from helixspark.operators import scoring as C
from helixspark.sources import tables as T


def run_etl(raw: DataFrame, path: str) -> DataFrame:
    """Normalised, classified, deduplicated variants published at path/variants, by chromosome, and their report (source, class, type: n)
    at path/report. The report is made of the written table. Returns the report."""
    spark = raw.sparkSession
    T.publish(N.etl(raw), f"{path}/variants", ["chrom"])
    report = T.current(spark, f"{path}/variants").groupBy("source_db", "pathogenicity", "variant_type").agg(F.count("*").alias("n"))
    T.publish(report, f"{path}/report")
    return T.current(spark, f"{path}/report")


def run_preparation(raw: DataFrame, lookups: list[R.Lookup], path: str, scale: bool = True, clean: bool = False) -> DataFrame:
    """The prepared table published at path/splits, a folder a split: what is known of the variants (normalised already if `clean`), labels
    and (scaled) features. The table is made once and written; scaling and publishing read that, split by split, and deal no rows again.
    Returns a row a split with rows, positives and genes; fails before it publishes if the labels lack a class."""
    spark = raw.sparkSession
    classes = Observation("labels")
    table = (R.prepared_clean if clean else R.prepared)(raw, lookups)
    checked = table.observe(classes, F.count_if(F.col("label") == 1).alias("positive"), F.count_if(F.col("label") == 0).alias("negative"))
    staged = T.staged(checked, "prepared", ["split"])
    if not classes.get["positive"] or not classes.get["negative"]:
        raise ValueError(f"both classes are needed, found {classes.get}")
    parts = {value: staged.where(F.col("split") == value) for (value,) in staged.select("split").distinct().collect()}
    if scale:
        fitted = R.scaling(staged)
        parts = {value: R.scaled(part, fitted) for value, part in parts.items()}
    T.publish_parts(spark, parts, f"{path}/splits", "split")
    return T.current(spark, f"{path}/splits").groupBy("split").agg(F.count("*").alias("n"), F.sum("label").alias("n_pos"), F.count_distinct("gene_symbol").alias("n_genes"))


def save_reference(reference: DataFrame, features: list[str], path: str) -> None:
    """The reference's statistics, published; later runs don't need its rows."""
    T.publish(D.reference_statistics(reference, features), path)


def new_counts(stats: DataFrame, new: DataFrame, features: list[str]) -> DataFrame:
    """The stored statistics with m (numbers of the new rows) and fresh (their counts in the stored bins): one pass over the new rows.
    Features that the new rows lack count as 0 in all of them."""
    aligned = new.select(*[(F.col(c) if c in new.columns else F.lit(0.0)).cast("double").alias(c) for c in features])
    long = aligned.unpivot([], features, "feature", "x").where("x IS NOT NULL AND NOT isnan(x)")
    bins = F.size("counts")
    k = F.when((F.col("hi") > F.col("lo")) & F.col("x").between(F.col("lo"), F.col("hi")), F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), bins - 1)).cast("int")
    cells = long.join(F.broadcast(stats), "feature").groupBy("feature", k.alias("bin")).agg(F.count("*").alias("c"))  # stats: a row a feature
    packed = cells.groupBy("feature").agg(F.sum("c").alias("m"), F.map_from_entries(F.collect_list(F.when(F.col("bin").isNotNull(), F.struct("bin", "c")))).alias("_of"))
    joined = stats.join(packed, "feature")
    return joined.withColumn("fresh", F.transform(F.sequence(F.lit(0), bins - 1), lambda i: F.coalesce(F.try_element_at("_of", i), F.lit(0).cast("long")))).drop("_of")


def run_drift(spark: SparkSession, reference_path: str, new: DataFrame, features: list[str], label_report: DataFrame, path: str) -> tuple[DataFrame, dict]:
    """One row (features to retrain and to monitor, the first drifted ones, both actions, whether to retrain and the exit severity) and the
    observed number of new rows; the reports by feature and overall are published below path. Every table is read once."""
    rows = Observation("new rows")
    stats = T.current(spark, reference_path)
    report = D.compared(new_counts(stats, new.observe(rows, F.count("*").alias("n")), features))
    T.publish(report, f"{path}/features")
    overall = D.overall_action(T.current(spark, f"{path}/features"))
    both = overall.crossJoin(F.broadcast(D.decision(overall, label_report)))  # one row each
    T.publish(both, f"{path}/overall")
    return T.current(spark, f"{path}/overall"), rows.get


def fit_pipeline(rows: DataFrame, features: list[str], train: Column, calibration: Column, path: str, model: Estimator | None = None) -> None:
    """Fits assembler, scaler and model on the training rows and a logistic calibration of its margins on the calibration rows, and saves
    them as one pipeline model below path; the features and the fitting rows' numbers are published with it. The fits pass over their rows
    many times, so these are made once and written, with nothing but what the fits read."""
    rows = T.staged(rows.select("label", *features, train.alias("_train"), calibration.alias("_calibration")).where("_train OR _calibration"), "fit")
    train, calibration = F.col("_train"), F.col("_calibration")
    model = model or LogisticRegression(regParam=0.01)
    model = model.copy().setFeaturesCol("_features").setLabelCol("label").setRawPredictionCol("_margin").setPredictionCol("_class")
    if model.hasParam("probabilityCol"):
        model = model.setProbabilityCol("_probability")
    stages: list[Transformer] = [VectorAssembler(inputCols=features, outputCol="_assembled", handleInvalid="error")]
    for stage, fit in ((StandardScaler(inputCol="_assembled", outputCol="_features", withMean=True), train), (model, train), (LogisticRegression(featuresCol="_margin", labelCol="label", rawPredictionCol="_log_odds", predictionCol="_calibrated_class", probabilityCol="_score"), calibration)):
        stages.append(stage.fit(PipelineModel(stages).transform(rows.where(fit))))
    PipelineModel(stages).write().overwrite().save(f"{path}/model")
    counts = rows.agg(F.count_if(train).alias("n_train"), F.count_if(calibration).alias("n_calibration"))
    T.publish(counts.withColumn("features", F.array(*[F.lit(f) for f in features])), f"{path}/about")


def score_batch(rows: DataFrame, path: str) -> DataFrame:
    """The rows with score, tier and confidence from the saved pipeline; columns of other names stay, features that rows lack count as 0."""
    spark = rows.sparkSession
    features = T.current(spark, f"{path}/about").first()["features"]
    filled = rows.withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) if f in rows.columns else F.lit(0.0) for f in features})
    scored = PipelineModel.load(f"{path}/model").transform(filled).withColumn("score", vector_to_array("_score")[1])
    return C.scored_in_tiers(scored.drop("_assembled", "_features", "_margin", "_class", "_probability", "_log_odds", "_calibrated_class", "_score"))
