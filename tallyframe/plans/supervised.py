"""Supervised baselines over the documents: predictions, learning curves and crossover sizes.

Iterative fits are not SQL; tests hold these queries against dense fits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import learning as s
from ..operators import metrics as m
from ..sources.shared import written
from .fixtures import decisions, label_def, table
from .registry import query, rounded


def golds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each document, and two binary fields of those with labels: ``task, kind, label_field, doc_id, gold, fold``."""
    docs = table(spark, sf_dir, "documents").filter("lang IS NOT NULL").select(F.lit("lang").alias("task"), F.lit("categorical").alias("kind"), F.lit("lang").alias("label_field"), "doc_id", F.col("lang").alias("gold"))
    fields = F.inline(F.array(*(F.struct(F.lit(c).alias("label_field"), F.col(c).cast("string").alias("gold")) for c in ("quality", "toxic"))))
    labels = table(spark, sf_dir, "labels").select(F.lit("content").alias("task"), F.lit("multi_binary").alias("kind"), "doc_id", fields).filter("gold IS NOT NULL")
    return s.with_fold(docs.unionByName(labels), "doc_id")


def predictions(spark: SparkSession, sf_dir: str, largest: bool) -> tuple[DataFrame, DataFrame]:
    """Golds, and what models of every size or the ``largest`` say of them."""
    rows = golds(spark, sf_dir)
    texts = s.with_fold(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "fold", "text")
    models = s.fit_models(s.training_prefixes(rows, "doc_id"), texts, "doc_id", largest=largest)
    return rows, s.predict_out_of_fold(texts, models, "doc_id")


@query()
def text_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document by the model with most training rows that has not seen it."""
    return predictions(spark, sf_dir, True)[1].filter("task = 'lang'").select("doc_id", "size", "pred")


def curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headline F1 and share of rows with every field right by task, size and fold; the fold is also the draw's seed."""
    rows, found = predictions(spark, sf_dir, False)
    both = rows.join(found.hint("shuffle_merge"), ["doc_id", "task", "label_field", "fold"]).withColumn("model", F.concat_ws(":", "size", "fold"))
    # Read several times, by sums only: answers are so alike that their files are small however many rows they hold, and a join with them would be a broadcast.
    both = written(both.select("task", "kind", "label_field", "doc_id", "gold", "pred", "model"), "predictions")
    labels = rows.filter("kind = 'categorical' OR gold = '1'").select("task", "kind", "label_field", F.col("gold").alias("label")).distinct()
    f1 = m.headline_f1(both, labels).select("task", "model", "headline_f1")
    right = both.groupBy("task", "model", "doc_id").agg(F.min((F.col("gold") == F.col("pred")).cast("double")).alias("right"))
    right = right.groupBy("task", "model").agg(F.avg("right").alias("accuracy"), F.count("*").alias("n_test"))
    at = F.split("model", ":")
    done = f1.join(right, ["task", "model"]).select("task", at[0].cast("int").alias("size"), at[1].cast("int").alias("fold"), "headline_f1", "accuracy", "n_test")
    sizes, folds = F.explode(F.array(*map(F.lit, s.SIZES))), F.explode(F.array(*map(F.lit, range(s.FOLDS))))
    cells = rows.select("task").distinct().select("task", sizes.alias("size")).select("*", folds.alias("fold"))
    return cells.join(done, ["task", "size", "fold"], "left")


@query()
def learning_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sizes and folds; null where the pool is smaller than the size."""
    return rounded(curve(spark, sf_dir))


@query()
def crossover_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training rows at which a supervised baseline reaches the best answering model, by task."""
    rows = decisions(spark, sf_dir)
    many = rows.filter("task IN ('quality', 'toxic')").withColumns({"task": F.lit("content"), "kind": F.lit("multi_binary")})
    labels = label_def(spark)
    both = labels.filter("kind = 'binary'").withColumns({"task": F.lit("content"), "kind": F.lit("multi_binary")})
    rows, labels = rows.filter("task = 'lang'").unionByName(many), labels.filter("task = 'lang'").unionByName(both)
    best = m.headline_f1(m.with_policy(rows, "wrong"), labels).groupBy("task").agg(F.max("headline_f1").alias("best"))
    return rounded(s.crossover(curve(spark, sf_dir).join(F.broadcast(best), "task"), "size", "headline_f1", F.col("best"), ["task"]))
