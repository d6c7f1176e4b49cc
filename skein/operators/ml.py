"""Feature vectors, k-means, projection: on pyspark.ml."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, Normalizer, OneHotEncoder, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_vectors(df: DataFrame, column: str = "embedding") -> DataFrame:
    good = F.col(column).isNotNull() & ~F.exists(column, lambda x: x.isNull() | F.isnan(x))
    return df.filter(good).withColumn("features", array_to_vector(F.col(column).cast("array<double>")))


def kmeans(df: DataFrame, k: int = 100, turns: int = 5, cosine: bool = False, seed: int = 1234):
    """(assignments, centres, cost) of k-means|| seeding and ``turns`` steps; spherical with cosine."""
    fitted = KMeans(k=k, maxIter=turns, seed=seed, distanceMeasure="cosine" if cosine else "euclidean", initMode="k-means||").fit(df)
    return fitted.transform(df).withColumnRenamed("prediction", "cluster"), fitted.clusterCenters(), fitted.summary.trainingCost


def normalized_kmeans(df: DataFrame, k: int = 1000, turns: int = 20, seed: int = 1234):
    own = Normalizer(inputCol="features", outputCol="unit", p=2.0).transform(df).drop("features").withColumnRenamed("unit", "features")
    return kmeans(own, k, turns, seed=seed)


def inertia(df: DataFrame, ks: tuple[int, ...] = (5, 8, 11), seed: int = 1234) -> list[tuple[int, float]]:
    return [(k, kmeans(df, k, 20, seed=seed)[2]) for k in ks]


def project(df: DataFrame, dims: int = 2) -> DataFrame:
    """Principal components: what stands in for a non-linear 2-D embedding, which Spark has no operator for."""
    return PCA(k=dims, inputCol="features", outputCol="pc").fit(df).transform(df).withColumn("pc", vector_to_array("pc"))


def one_hot(df: DataFrame, column: str) -> DataFrame:
    indexed = StringIndexer(inputCol=column, outputCol=f"{column}_idx", handleInvalid="keep").fit(df).transform(df)
    return OneHotEncoder(inputCol=f"{column}_idx", outputCol=f"{column}_vec", dropLast=False).fit(indexed).transform(indexed)


def sparse_set(size: int, index: int, value: str) -> list[str]:
    """A list of '0' with one value set."""
    out = ["0"] * max(size, index + 1)
    out[index] = value
    return out


def counter_stats(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Mean, median (plain, low, high), mode, variances, deviations and maximum of counts."""
    v = F.col(value)
    half = F.array_sort(F.collect_list(v))
    return df.groupBy(*(by or [])).agg(
        F.avg(v).alias("mean"), F.median(v).alias("median"), F.percentile_disc(0.5, v).alias("median_low") if hasattr(F, "percentile_disc") else F.get(half, F.floor((F.count(v) - 1) / 2).cast("int")).alias("median_low"),
        F.get(half, F.floor(F.count(v) / 2).cast("int")).alias("median_high"), F.mode(v, True).alias("mode"),
        F.var_samp(v).alias("variance"), F.var_pop(v).alias("pvariance"), F.stddev_samp(v).alias("stdev"), F.stddev_pop(v).alias("pstdev"), F.max(v).alias("max"),
    )
