"""Fitted models on pyspark.ml: missingness, drift, durations, composites, classifiers, prototypes."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import AFTSurvivalRegression, GeneralizedLinearRegression, IsotonicRegression, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def design(numeric: Sequence[str], categorical: Sequence[str] = ()) -> list:
    """Stages that assemble a feature vector; categories are coded alphabetically without their first level."""
    coded = [f"{c}__i" for c in categorical]
    hot = [f"{c}__v" for c in categorical]
    stages = [StringIndexer(inputCols=list(categorical), outputCols=coded, stringOrderType="alphabetDesc", handleInvalid="keep"), OneHotEncoder(inputCols=coded, outputCols=hot)] if categorical else []
    return [*stages, VectorAssembler(inputCols=[*numeric, *hot], outputCol="features", handleInvalid="keep")]


def positive(column: str = "probability") -> Column:
    return vector_to_array(column)[1]


def missingness(rows: DataFrame, missing: Column, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """One row: n, the log-likelihoods of a logistic model of missingness and of the base rate, LR and degrees of freedom."""
    data = rows.fillna(0.0, list(numeric)).withColumn("label", missing.cast("double"))
    model = Pipeline(stages=[*design(numeric, categorical), LogisticRegression(regParam=0.0, maxIter=50)]).fit(data)
    p = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), positive()))
    rate = F.avg("label")
    sums = model.transform(data).agg(F.count(F.lit(1)).alias("n"), rate.alias("rate"), F.sum(F.when(F.col("label") == 1, F.log(p)).otherwise(F.log(1 - p))).alias("ll"))
    null = F.col("n") * (F.when(F.col("rate") > 0, F.col("rate") * F.log("rate")).otherwise(0.0) + F.when(F.col("rate") < 1, (1 - F.col("rate")) * F.log(1 - F.col("rate"))).otherwise(0.0))
    df = model.stages[-1].coefficients.size
    return sums.select("n", "ll", null.alias("ll_null"), (2 * (F.col("ll") - null)).alias("lr"), F.lit(df).alias("df"))


def mahalanobis(rows: DataFrame, numeric: Sequence[str], train: Column, quantile: float = 0.95, ridge: float = 1e-6) -> DataFrame:
    """rows with their distance from the train rows' mean and whether it is beyond the train rows' quantile.

    The covariance comes from one pass of sums; its inverse, of the number of columns squared, from the driver."""
    pairs = [(i, j) for i in range(len(numeric)) for j in range(i, len(numeric))]
    stats = rows.where(train).agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(numeric)], *[F.covar_samp(numeric[i], numeric[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    cov = np.zeros((len(numeric), len(numeric)))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = stats[f"c{i}_{j}"]
    inverse = np.linalg.inv(cov + ridge * np.eye(len(numeric)))
    centred = [F.col(c) - F.lit(stats[f"m{i}"]) for i, c in enumerate(numeric)]
    square = sum((centred[i] * centred[j] * float(inverse[i, j]) for i in range(len(numeric)) for j in range(len(numeric))), F.lit(0.0))
    out = rows.withColumn("distance", F.sqrt(F.greatest(F.lit(0.0), square)))
    cut = out.where(train).agg(F.percentile("distance", F.lit(quantile)).alias("cut"))
    return out.crossJoin(F.broadcast(cut)).withColumn("far", F.col("distance") > F.col("cut")).drop("cut")


def isolation_scores(rows: DataFrame, numeric: Sequence[str], *, trees: int = 50, sample: int = 256, seed: int = 42) -> DataFrame:
    """rows with isolation, the score 2^(-mean depth / expected depth) of a forest grown on a bounded sample.

    The trees see at most trees * sample rows, those with the smallest hashes, as the method prescribes; all rows
    are scored, by Arrow batches."""
    keyed = rows.select(*numeric).where(" and ".join(f"{c} is not null" for c in numeric)).withColumn("h", F.xxhash64(*numeric, F.lit(seed)))
    data = keyed.orderBy("h").limit(trees * sample).drop("h").toPandas().to_numpy(float)
    rng = np.random.default_rng(seed)
    rng.shuffle(data)
    most = max(1, math.ceil(math.log2(max(2, min(sample, len(data))))))

    def expected(n: int) -> float:
        return 0.0 if n < 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def grow(x: np.ndarray, depth: int):
        spread = np.ptp(x, axis=0) if len(x) else np.zeros(x.shape[1])
        if depth >= most or len(x) < 2 or not spread.any():
            return depth + expected(len(x))
        f = rng.choice(np.flatnonzero(spread))
        cut = rng.uniform(x[:, f].min(), x[:, f].max())
        return int(f), float(cut), grow(x[x[:, f] < cut], depth + 1), grow(x[x[:, f] >= cut], depth + 1)

    parts = np.array_split(data, max(1, min(trees, len(data) // 2 or 1)))
    forest = [grow(p[:sample], 0) for p in parts]
    norm = max(expected(min(sample, len(parts[0]))), 1e-9)

    def depth(tree, x: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        f, cut, low, high = tree
        out, left = np.empty(len(x)), x[:, f] < cut
        out[left], out[~left] = depth(low, x[left]), depth(high, x[~left])
        return out

    @F.pandas_udf("double")
    def score(columns: pd.DataFrame) -> pd.Series:
        x = columns.to_numpy(float)
        return pd.Series(2.0 ** (-np.mean([depth(t, x) for t in forest], axis=0) / norm))

    return rows.withColumn("isolation", score(F.struct(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in numeric])))


def aft_weibull(rows: DataFrame, time: str, event: str, numeric: Sequence[str]) -> DataFrame:
    """rows of positive time with the expected time and the median of a Weibull accelerated-failure model."""
    data = rows.where((F.col(time) > 0) & F.col(time).isNotNull()).fillna(0.0, list(numeric)).withColumn("label", F.col(time).cast("double")).withColumn("censor", F.col(event).cast("double"))
    model = Pipeline(stages=[*design(numeric), AFTSurvivalRegression(quantileProbabilities=[0.5], quantilesCol="quantiles", maxIter=50)]).fit(data)
    return model.transform(data).withColumn("p50", vector_to_array("quantiles")[0]).withColumnRenamed("prediction", "expected").drop("features", "quantiles", "label", "censor")


def lognormal_aft(rows: DataFrame, time: str, numeric: Sequence[str]) -> tuple[DataFrame, float]:
    """rows of positive time with the log mean of a lognormal model of uncensored times, and its deviation."""
    data = rows.where(F.col(time) > 0).fillna(0.0, list(numeric)).withColumn("label", F.log(F.col(time).cast("double")))
    model = Pipeline(stages=[*design(numeric), LinearRegression()]).fit(data)
    return model.transform(data).withColumnRenamed("prediction", "log_mean").drop("features", "label"), model.stages[-1].summary.rootMeanSquaredError


def first_component(dim: DataFrame, numeric: Sequence[str], sign_of: str) -> DataFrame:
    """dim with pc1, the first principal component of its standardised columns on a 0 to 100 scale, turned so
    that it grows with sign_of."""
    stages = [*design(numeric), StandardScaler(withMean=True, withStd=True, inputCol="features", outputCol="scaled"), PCA(k=1, inputCol="scaled", outputCol="pc")]
    out = Pipeline(stages=stages).fit(dim).transform(dim).withColumn("raw", vector_to_array("pc")[0]).drop("features", "scaled", "pc")
    part = W.partitionBy()
    turned = out.withColumn("raw", F.col("raw") * F.when(F.corr("raw", sign_of).over(part) < 0, -1.0).otherwise(1.0))
    low, high = F.min("raw").over(part), F.max("raw").over(part)
    return turned.withColumn("pc1", F.when(high > low, 100 * (F.col("raw") - low) / (high - low)).otherwise(50.0)).drop("raw")


def boosted_classifier(rows: DataFrame, label: Column, train: Column, numeric: Sequence[str], least_positive: int = 10, seed: int = 42) -> DataFrame:
    """rows with p by boosted trees fitted on the train rows; the base rate where there are too few of a class."""
    data = rows.fillna(0.0, list(numeric)).withColumn("label", label.cast("double"))
    counts = data.where(train).agg(F.sum("label").alias("pos"), F.count(F.lit(1)).alias("n")).first()
    if not counts["n"] or min(counts["pos"], counts["n"] - counts["pos"]) < least_positive:
        return data.withColumn("p", F.lit((counts["pos"] or 0.0) / max(1, counts["n"])))
    model = Pipeline(stages=[*design(numeric), GBTClassifier(maxIter=10, maxDepth=4, seed=seed)]).fit(data.where(train))
    return model.transform(data).withColumn("p", positive()).drop("features", "rawPrediction", "probability", "prediction")


def calibrate(rows: DataFrame, p: str, y: Column, fit: Column) -> DataFrame:
    """rows with calibrated, an isotonic function of p that was fitted on other rows than those it is judged on."""
    data = rows.withColumn("label", y.cast("double")).withColumn("features", F.col(p))
    return IsotonicRegression().fit(data.where(fit)).transform(data).withColumnRenamed("prediction", "calibrated").drop("features", "label")


def poisson_counts(rows: DataFrame, y: str, train: Column, numeric: Sequence[str]) -> DataFrame:
    """rows with expected counts of a Poisson model."""
    data = rows.fillna(0.0, list(numeric)).withColumn("label", F.col(y).cast("double")).where(F.col("label").isNotNull())
    model = Pipeline(stages=[*design(numeric), GeneralizedLinearRegression(family="poisson", link="log", maxIter=25, regParam=1e-6)]).fit(data.where(train))
    return model.transform(data).withColumnRenamed("prediction", "expected").drop("features", "label")


def prototypes(rows: DataFrame, key: str, numeric: Sequence[str], k: int, seed: int = 42) -> DataFrame:
    """rows with their cluster of standardised columns and whether they are its medoid, the row nearest to its centre."""
    data = rows.fillna(0.0, list(numeric))
    model = Pipeline(stages=[*design(numeric), StandardScaler(withMean=True, inputCol="features", outputCol="scaled"), KMeans(k=k, seed=seed, featuresCol="scaled", predictionCol="cluster")]).fit(data)
    centres = rows.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.stages[-1].clusterCenters())], "cluster int, centre array<double>")
    out = model.transform(data).join(F.broadcast(centres), "cluster")
    d2 = F.aggregate(F.zip_with(vector_to_array("scaled"), "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    ranked = out.withColumn("d2", d2)
    medoids = ranked.groupBy("cluster").agg(F.min(F.struct("d2", key)).alias("m")).select("cluster", F.col(f"m.{key}").alias("medoid"))
    return ranked.join(F.broadcast(medoids), "cluster").withColumn("is_medoid", F.col(key) == F.col("medoid")).drop("features", "scaled", "centre", "medoid")


def rank_stability(dim: DataFrame, key: str, score: str, *, simulations: int = 200, noise: float = 0.05, top: int = 10, seed: int = 42) -> DataFrame:
    """key and the share of simulations with noise on the score in which it ranks among the top."""
    drawn = dim.select(key, score).withColumn("sim", F.explode(F.sequence(F.lit(1), F.lit(simulations))))
    uniform = lambda salt: (F.pmod(F.xxhash64(key, "sim", F.lit(salt), F.lit(seed)), F.lit(1 << 30)) + 0.5) / F.lit(float(1 << 30))
    gauss = F.sqrt(-2 * F.log(uniform("a"))) * F.cos(2 * math.pi * uniform("b"))
    ranked = drawn.withColumn("drawn", F.col(score) * (1 + noise * gauss)).withColumn("r", F.row_number().over(W.partitionBy("sim").orderBy(F.desc("drawn"), key)))
    return ranked.groupBy(key).agg(F.avg((F.col("r") <= top).cast("double")).alias("p_top"), F.avg("r").alias("mean_rank"))


def permutation_p(dim: DataFrame, weights: DataFrame, key: str, value: str, *, permutations: int = 199, seed: int = 42) -> DataFrame:
    """key and the share of random relabellings of the other places whose local sum is as far out as the real one."""
    n = dim.count()
    values = dim.select(key, value).withColumn("i", F.row_number().over(W.orderBy(key)) - 1)
    shuffled = dim.select(key).withColumn("sim", F.explode(F.sequence(F.lit(1), F.lit(permutations)))).withColumn("i", F.row_number().over(W.partitionBy("sim").orderBy(F.xxhash64(key, "sim", F.lit(seed)))) - 1)
    drawn = shuffled.join(F.broadcast(values.select("i", F.col(value).alias("v"))), "i").select("sim", F.col(key).alias("neighbour"), "v")
    real = weights.join(dim.select(F.col(key).alias("neighbour"), F.col(value).alias("v")), "neighbour").groupBy(key).agg(F.sum("v").alias("real"))
    sims = weights.join(drawn, "neighbour").groupBy(key, "sim").agg(F.sum("v").alias("s")).join(real, key)
    return sims.groupBy(key).agg(((F.sum((F.col("s") >= F.col("real")).cast("int")) + 1) / (permutations + 1)).alias("p_high"), F.first("real").alias("local_sum"), F.lit(n).alias("places"))
