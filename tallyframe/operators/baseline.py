"""Nearest centroids of embeddings; ``learning`` has the text baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def nearest_centroid(train: DataFrame, test: DataFrame, vector: str, label: str, key: str) -> DataFrame:
    """The label whose mean vector has the largest cosine with the row's; ties go to the smallest label.

    Centroids are one row for each label. Components are averaged by place, so no vector is collected.
    """
    long = train.select(label, F.posexplode(vector).alias("i", "v"))
    mean = long.groupBy(label, "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    norm = F.sqrt(F.sum(F.col("m") ** 2).over(W.partitionBy(label)))
    centroid = mean.select(label, "i", (F.col("m") / norm).alias("m"))
    dots = test.select(key, F.posexplode(vector).alias("i", "v")).join(F.broadcast(centroid), "i").groupBy(key, label).agg(F.sum(F.col("v") * F.col("m")).alias("dot"))
    return dots.groupBy(key).agg(F.min_by(label, F.struct(-F.round("dot", 9), F.col(label))).alias("pred"))


def nearest_centroid_out_of_fold(rows: DataFrame, vector: str, label: str, key: str, fold: str) -> DataFrame:
    """As ``nearest_centroid`` for every row, by the centroids of the other folds.

    Sums are made once by label, fold and place; a fold's centroids are the sums of all folds less its own. What meets the rows is one
    number for each fold, label and place, however many rows there are.
    """
    long = rows.select(fold, key, F.col(label).alias("_l"), F.posexplode(vector).alias("_i", "_v")).withColumn("_v", F.col("_v").cast("double"))
    sums = long.groupBy("_l", "_i", fold).agg(F.sum("_v").alias("_s"), F.count("_v").alias("_n"))
    folds = F.broadcast(rows.select(F.col(fold).alias("_f")).distinct())
    means = sums.join(folds, F.col(fold) != F.col("_f")).groupBy("_f", "_l", "_i").agg((F.sum("_s") / F.sum("_n")).alias("_m"))
    centroid = means.withColumn("_m", F.col("_m") / F.sqrt(F.sum(F.col("_m") ** 2).over(W.partitionBy("_f", "_l"))))
    dots = long.select(key, F.col(fold).alias("_f"), "_i", "_v").join(centroid, ["_f", "_i"]).groupBy(key, "_l").agg(F.round(F.sum(F.col("_v") * F.col("_m")), 9).alias("_dot"))
    return dots.groupBy(key).agg(F.min_by("_l", F.struct(-F.col("_dot"), F.col("_l"))).alias("pred"))
