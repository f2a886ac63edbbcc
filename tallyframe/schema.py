"""The canonical tables and their types. Keys are always strings; missing values are always null."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(text: str) -> T.StructType:
    return T.StructType.fromDDL(text)


PREDICTION = _struct("task STRING, model STRING, batch_size INT, item_id STRING, latency_s DOUBLE, batch_latency_s DOUBLE, eval_count INT, parse_error STRING, raw_content STRING")
DECISION = _struct("task STRING, kind STRING, model STRING, batch_size INT, item_id STRING, label_field STRING, gold STRING, pred STRING, gold_num DOUBLE, pred_num DOUBLE, parse_error STRING")
LABEL_DEF = _struct("task STRING, kind STRING, label_field STRING, label STRING, pos INT, ordinal BOOLEAN, lo DOUBLE, hi DOUBLE")
ITEM = _struct("task STRING, pos INT, item_id STRING, user_content STRING, gold MAP<STRING,STRING>")
MODEL_DEF = _struct("model STRING, family STRING, compute_class STRING, cost_per_call_usd DOUBLE, release_date DATE")
KINDS = ("binary", "categorical", "multi_binary", "score")
