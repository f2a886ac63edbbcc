"""An evaluation built from the synthetic tables: gold labels, and answers of five models by integer rules.

The frames here and the SQL text give the same rows, so every operator can be checked by a second engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.reshape import dealt

MODELS = 5
#: The order of each task in the rules, its kind, and its labels by position.
TASKS = {"toxic": (1, "binary"), "quality": (2, "binary"), "lang": (3, "categorical"), "priority": (4, "categorical"), "size": (5, "score")}
LANGS = ("en", "de", "fr", "es", "it")
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
FAMILY = {"m1": "alpha", "m2": "alpha", "m3": "beta", "m4": "beta", "m5": "gamma"}
CLASS = {"m1": "local", "m2": "api", "m3": "local", "m4": "api", "m5": "api"}
CATEGORY = {"toxic": "content", "quality": "content", "lang": "form", "priority": "order", "size": "order"}
LO, HI = 1.0, 50.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def models(spark: SparkSession) -> DataFrame:
    rows = [(f"m{k}", k, FAMILY[f"m{k}"], CLASS[f"m{k}"], k / 1000) for k in range(1, MODELS + 1)]
    df = literal_rows(spark, rows, "model string, k int, family string, compute_class string, cost_per_call_usd double")
    return df.withColumn("release_date", F.date_add(F.lit("2024-01-01").cast("date"), F.col("k") * 90))


def tasks(spark: SparkSession) -> DataFrame:
    return literal_rows(spark, [(t, o, k, CATEGORY[t]) for t, (o, k) in TASKS.items()], "task string, task_order int, kind string, category string")


def label_def(spark: SparkSession) -> DataFrame:
    """Declared labels; ``it`` never occurs as gold."""
    rows = [(t, "binary", t, "1", 1, False) for t in ("toxic", "quality")]
    rows += [("lang", "categorical", "lang", x, i, False) for i, x in enumerate(LANGS)]
    rows += [("priority", "categorical", "priority", x, i + 1, True) for i, x in enumerate(PRIORITIES)]
    return literal_rows(spark, rows, "task string, kind string, label_field string, label string, pos int, ordinal boolean")


def _wrong(k: Column, t: int) -> Column:
    return F.pmod(F.col("id") * 31 + k * 17 + t * 5, F.lit(10)) < 1 + F.pmod(k * t, F.lit(5))


def _next(label: Column, labels: tuple[str, ...]) -> Column:
    known = F.array(*map(F.lit, labels))
    at = F.array_position(known, label)
    return F.when(at > 0, F.element_at(known, (F.pmod(at, F.lit(len(labels))) + 1).cast("int")))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """task, kind, id and gold of every item."""
    labels, docs, orders, part = (table(spark, sf_dir, n) for n in ("labels", "documents", "orders", "part"))
    one = lambda df, task, key, gold: df.select(F.lit(task).alias("task"), F.lit(TASKS[task][1]).alias("kind"), F.col(key).cast("long").alias("id"), F.col(gold).cast("string").alias("gold"))
    parts = [one(labels, "toxic", "doc_id", "toxic"), one(labels, "quality", "doc_id", "quality"), one(docs, "lang", "doc_id", "lang"), one(orders, "priority", "o_orderkey", "o_orderpriority"), one(part, "size", "p_partkey", "p_size")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def items_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items with ``item_id``, dealt by item before any model answers them."""
    return dealt(items(spark, sf_dir).withColumn("item_id", F.col("id").cast("string")), ["item_id", "task"])


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each (task, model, item): the answers of five models to every item."""
    return answers(items(spark, sf_dir).withColumn("item_id", F.col("id").cast("string")))


def answers(items: DataFrame) -> DataFrame:
    """The answers of five models to items; how items were dealt stays."""
    rows = items.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(MODELS))))
    k = F.col("k")
    failed = F.pmod(F.col("id") * 7 + k * 13, F.when(k == 5, 17).otherwise(29)) == 0
    void = (F.col("task") == "size") & (F.pmod(F.col("id") * 7 + k * 13, F.lit(31)) == 0)
    error = F.when(void, "not_applicable").when(failed, "parse_fail")
    flip = F.when(F.col("gold") == "1", "0").otherwise("1")
    answer = F.col("gold")
    for task, (t, kind) in TASKS.items():
        other = flip if kind == "binary" else _next(F.col("gold"), LANGS if task == "lang" else PRIORITIES) if kind == "categorical" else (F.col("gold").try_cast("int") + k).cast("string")
        answer = F.when((F.col("task") == task) & _wrong(k, t), other).otherwise(answer)
    rows = rows.withColumn("parse_error", error).withColumn("pred", F.when(error.isNull(), answer))
    score = F.col("kind") == "score"
    return rows.select(
        "task",
        "kind",
        F.concat(F.lit("m"), k.cast("string")).alias("model"),
        F.lit(1).alias("batch_size"),
        "item_id",
        F.col("task").alias("label_field"),
        "gold",
        "pred",
        F.when(score, F.col("gold").try_cast("double")).alias("gold_num"),
        F.when(score, F.col("pred").try_cast("double")).alias("pred_num"),
        "parse_error",
        F.col("id"),
        k.alias("k"),
    )


def latency(k: Column, item: Column) -> Column:
    """Seconds that an answer took; none where the id ends in 9."""
    return F.when(F.pmod(item, F.lit(10)) != 9, (F.pmod(item * 37 + k * 11, F.lit(1000)) + 1) / 1000.0)


def _sql_values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


_LANG_LIST = "[" + ", ".join(f"'{x}'" for x in LANGS) + "]"
_PRIORITY_LIST = "[" + ", ".join(f"'{x}'" for x in PRIORITIES) + "]"
_NEXT = "{0}[list_position({0}, gold) % 5 + 1]"

SQL_MODELS = f"""models AS (SELECT model, k, family, compute_class, k / 1000.0::DOUBLE AS cost_per_call_usd, DATE '2024-01-01' + (90 * k)::INT AS release_date
    FROM (VALUES {_sql_values([(f"m{k}", k, FAMILY[f"m{k}"], CLASS[f"m{k}"]) for k in range(1, MODELS + 1)])}) v(model, k, family, compute_class))"""
SQL_TASKS = f"tasks AS (SELECT * FROM (VALUES {_sql_values([(t, o, k, CATEGORY[t]) for t, (o, k) in TASKS.items()])}) v(task, task_order, kind, category))"
SQL_LABELS = f"""label_def AS (SELECT * FROM (VALUES {_sql_values([("toxic", "toxic", "1", 1), ("quality", "quality", "1", 1), *(("lang", "lang", x, i) for i, x in enumerate(LANGS)), *(("priority", "priority", x, i + 1) for i, x in enumerate(PRIORITIES))])}) v(task, label_field, label, pos))"""
SQL_ITEMS = """items AS (
    SELECT 'toxic' AS task, 'binary' AS kind, 1 AS t, doc_id::BIGINT AS id, toxic::VARCHAR AS gold FROM labels
    UNION ALL SELECT 'quality', 'binary', 2, doc_id, quality::VARCHAR FROM labels
    UNION ALL SELECT 'lang', 'categorical', 3, doc_id, lang FROM documents
    UNION ALL SELECT 'priority', 'categorical', 4, o_orderkey, o_orderpriority FROM orders
    UNION ALL SELECT 'size', 'score', 5, p_partkey, p_size::VARCHAR FROM part)"""
SQL_DECISIONS = f"""{SQL_ITEMS},
raw AS (SELECT *, (id * 31 + k * 17 + t * 5) % 10 < 1 + (k * t) % 5 AS bad,
    CASE WHEN task = 'size' AND (id * 7 + k * 13) % 31 = 0 THEN 'not_applicable' WHEN (id * 7 + k * 13) % (CASE WHEN k = 5 THEN 17 ELSE 29 END) = 0 THEN 'parse_fail' END AS parse_error
    FROM items, range(1, {MODELS + 1}) r(k)),
dec AS (SELECT task, kind, 'm' || k AS model, id::VARCHAR AS item_id, task AS label_field, gold, id, k::INT AS k, t, parse_error,
    CASE WHEN parse_error IS NULL THEN CASE WHEN NOT bad THEN gold WHEN kind = 'binary' THEN CASE WHEN gold = '1' THEN '0' ELSE '1' END
        WHEN task = 'lang' THEN {_NEXT.format(_LANG_LIST)} WHEN task = 'priority' THEN {_NEXT.format(_PRIORITY_LIST)} ELSE (gold::INT + k)::VARCHAR END END AS pred FROM raw)"""
SQL_LATENCY = "CASE WHEN id % 10 <> 9 THEN ((id * 37 + k * 11) % 1000 + 1) / 1000.0::DOUBLE END"
