"""Queries of parsing, inference, contracts, costs, trends, ledgers and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import api
from ..functions import parse as p
from ..operators import baseline as u
from ..operators import contracts as q
from ..operators import cost as h
from ..operators import inference as i
from ..operators import metrics as m
from ..operators import reshape as r
from ..operators import state as s
from ..operators import trends as g
from .comparing import META, SCORES, scores
from .fixtures import LANGS, SQL_DECISIONS, SQL_LATENCY, SQL_MODELS, SQL_TASKS, answers, decisions, items_apart, label_def, latency, models, table, tasks
from .registry import query, rounded


def raw_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of the language task as a model might write them: plain, fenced, bare, in other case, or none."""
    dec = decisions(spark, sf_dir).filter("task = 'lang'")
    form = F.col("id") % 5
    raw = F.when(F.col("parse_error").isNotNull(), "I cannot tell.").when(form == 0, F.format_string('{"lang": "%s"}', "pred"))
    raw = raw.when(form == 1, F.format_string('Sure:\n```json\n{"Lang": "%s"}\n```\nDone.', F.upper("pred"))).when(form == 2, F.format_string('"%s".', "pred"))
    raw = raw.when(form == 3, F.format_string("The language is %s", "pred")).otherwise(F.format_string('[{"lang": "%s", "note": 1}] extra', "pred"))
    return dec.withColumn("raw_content", raw)


SPEC = p.AnswerSpec("categorical", ("lang",), LANGS)


@query(f"WITH {SQL_DECISIONS} SELECT model, item_id, pred, CASE WHEN parse_error IS NOT NULL THEN 'no label' END AS parse_error FROM dec WHERE task = 'lang'")
def parsed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raw_answers(spark, sf_dir).select("model", "item_id", p.parsed(F.col("raw_content"), SPEC).alias("r"))
    return rows.select("model", "item_id", F.col("r.pred")["lang"].alias("pred"), F.col("r.parse_error").alias("parse_error"))


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k, len(json_keys(props)) = 1 AND json_keys(props)[1] = 'k' AND json_type(props, '$.k') IN ('UBIGINT', 'BIGINT') AND json_extract_string(props, '$.k')::INT BETWEEN 0 AND 50 AS strict FROM events""")
def strict_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = p.strict_object(F.col("props"), ["k"], "score", low=0, high=50)
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), ok.alias("strict"))


@query(f"""WITH {SQL_DECISIONS}, l AS (SELECT *, (row_number() OVER (PARTITION BY model ORDER BY id) - 1) // 10 AS batch, count(*) OVER (PARTITION BY model) AS n FROM dec WHERE task = 'lang'),
    b AS (SELECT *, count(*) OVER (PARTITION BY model, batch) AS size FROM l)
    SELECT model, item_id, batch, CASE WHEN batch % 7 = 3 THEN NULL ELSE pred END AS pred, batch % 7 = 3 AS void FROM b WHERE parse_error IS NULL OR batch % 7 = 3""")
def batched_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten items a call; a batch with an answer too few is void for all its items."""
    dec = decisions(spark, sf_dir).filter("task = 'lang'").withColumn("user_content", F.coalesce("pred", F.lit("?")))
    groups = i.batches(dec, 10, "id")
    answers = F.transform(F.regexp_extract_all("user_content", F.lit(r"(?m)^\d+[.] (.*)$"), F.lit(1)), lambda x: F.concat(F.lit('{"lang": "'), x, F.lit('"}')))
    short = F.when(F.col("batch") % 7 == 3, F.slice(answers, 2, 10)).otherwise(answers)
    groups = groups.withColumn("raw", F.concat(F.lit('{"results": ['), F.array_join(short, ", "), F.lit("]}")))
    rows = i.join_batch_answers(groups, p.parsed_batch(F.col("raw"), F.col("n"), SPEC))
    void = F.coalesce(F.contains("parse_error", F.lit("answers for")), F.lit(False))
    return rows.filter(F.col("parse_error").isNull() | void).select("model", "item_id", "batch", F.col("pred")["lang"].alias("pred"), void.alias("void"))


def stub_client() -> i.Client:
    """Answers from the text alone, and fails for texts that mention a seven."""

    def call(model: str, system: str, text: str) -> str:
        if "7" in text:
            raise ValueError("no sevens")
        return f'{{"parity": {(len(text) + len(model)) % 2}}}'

    return call


@query("""WITH d AS (SELECT doc_id::VARCHAR AS item_id, text AS u FROM documents), c AS (SELECT item_id, u, 'm' || k AS model FROM d, range(1, 6) r(k) WHERE NOT (k = 5))
    SELECT item_id, model, CASE WHEN u LIKE '%7%' THEN NULL ELSE '{"parity": ' || (length(u) + 2) % 2 || '}' END AS raw_content, CASE WHEN u LIKE '%7%' THEN 'ValueError: no sevens' END AS parse_error FROM c""")
def model_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item to every model but the skipped one; errors are rows."""
    items = table(spark, sf_dir, "documents").select(F.lit("lang").alias("task"), F.col("doc_id").cast("string").alias("item_id"), F.col("text").alias("user_content"))
    skip = models(spark).filter("k = 5").select("model", F.lit("lang").alias("task"))
    out = i.answer(i.plan_cells(items, models(spark), skip), stub_client)
    return out.select("item_id", "model", "raw_content", "parse_error")


@query("SELECT event_type AS task, (count(*) * 5)::BIGINT AS calls FROM events GROUP BY ALL")
def dry_run_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return i.dry_run(table(spark, sf_dir, "events").select(F.col("event_type").alias("task")), models(spark))


@query("""SELECT user_id, min(ts)::VARCHAR AS started_at, max(ts)::VARCHAR AS updated_at, max(ts) FILTER (event_type IN ('purchase', 'error'))::VARCHAR AS ended_at, arg_max(event_type, (ts, event_type)) AS last_event, count(*) AS events, arg_max(value, ts) FILTER (value IS NOT NULL) AS value FROM events GROUP BY user_id""")
def run_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last state of each run, from the event log."""
    out = s.latest_runs(table(spark, sf_dir, "events"), "user_id", "ts", "event_type", ["value"], ("purchase", "error"))
    return out.withColumns({c: F.col(c).cast("string") for c in ("started_at", "updated_at", "ended_at")})


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unfinished_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.unfinished(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("SELECT doc_id::VARCHAR AS doc_id, quality, toxic, CASE WHEN doc_id % 2 = 0 THEN 'new' END AS origin FROM labels WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id::VARCHAR, quality, toxic, NULL FROM labels WHERE doc_id % 2 = 1")
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return s.merge_into(old, old.filter("doc_id % 2 = 0").withColumn("origin", F.lit("new")), ["doc_id"])


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.repeated_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT c_custkey AS key, 'missing' AS side FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT DISTINCT o_custkey, 'unexpected' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)")
def key_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key")), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    return q.uncovered(orders, customers, ["key"])


@query("SELECT count(*) = max(o_orderkey) AND min(o_orderkey) = 1 AND count(DISTINCT o_orderkey) = count(*) AS full_range, count(*) AS n FROM orders")
def index_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.is_full_range(table(spark, sf_dir, "orders"), "o_orderkey")


_HARD = f"{SCORES}, w AS (SELECT a.task, a.id, a.gold = a.pred AS x, b.gold = b.pred AS y, a.kind FROM wrong a JOIN wrong b USING (task, id) WHERE a.model = 'm1' AND b.model = 'm2')"


@query(f"{_HARD} SELECT task, count(*) FILTER (x AND NOT y) AS only_first, count(*) FILTER (NOT x AND y) AS only_second, count(*) FILTER (x AND y) AS both_right, count(*) FILTER (NOT x AND NOT y) AS neither FROM w GROUP BY task")
def confusion_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where two models are right: one only, both, neither."""
    rows = m.with_policy(decisions(spark, sf_dir), "wrong").filter("kind <> 'score'").withColumn("ok", F.col("gold") == F.col("pred"))
    cell = rows.filter("model IN ('m1', 'm2')").groupBy("task", "item_id").agg(F.max(F.when(F.col("model") == "m1", F.col("ok"))).alias("x"), F.max(F.when(F.col("model") == "m2", F.col("ok"))).alias("y"))
    x, y = F.col("x"), F.col("y")
    return cell.groupBy("task").agg(F.count_if(x & ~y).alias("only_first"), F.count_if(~x & y).alias("only_second"), F.count_if(x & y).alias("both_right"), F.count_if(~x & ~y).alias("neither"))


@query(f"""WITH {SQL_DECISIONS}, {SQL_MODELS}, l AS (SELECT model, task, parse_error, gold, pred, {SQL_LATENCY} AS s FROM dec JOIN models USING (model, k)),
    a AS (SELECT model, count(*) AS n, median(s) AS median_latency_s, quantile_cont(s, 0.9) AS p90_latency_s, avg(s) AS mean_latency_s, count(parse_error) AS errors, avg((gold = pred)::INT) FILTER (pred IS NOT NULL AND task <> 'size') AS acc FROM l GROUP BY model)
    SELECT model, n, round(median_latency_s, 6) AS median_latency_s, round(p90_latency_s, 6) AS p90_latency_s, round(mean_latency_s, 6) AS mean_latency_s, round(60 / median_latency_s, 6) AS items_per_minute, round(median_latency_s * 1000 / 60, 6) AS minutes_per_1000, errors,
        round(CASE WHEN compute_class = 'local' THEN median_latency_s * 1000 / 3600 END, 6) AS gpu_hours_per_1000, round(cost_per_call_usd * 1000, 6) AS usd_per_1000, round(cost_per_call_usd * 1000 / acc, 6) AS usd_per_1000_correct FROM a JOIN models USING (model)""")
def latency_and_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    dec = decisions(spark, sf_dir).withColumn("latency_s", latency(F.col("k"), F.col("id")))
    ok = F.when(F.col("pred").isNotNull() & (F.col("kind") != "score"), (F.col("gold") == F.col("pred")).cast("double"))
    rows = h.latency_summary(dec, "model", "latency_s", "parse_error").join(dec.groupBy("model").agg(F.avg(ok).alias("acc")), "model").join(F.broadcast(models(spark)), "model")
    usd = h.usd_per_1000(F.col("cost_per_call_usd"))
    cols = ["model", "n", "median_latency_s", "p90_latency_s", "mean_latency_s", "items_per_minute", "minutes_per_1000", "errors"]
    return rounded(rows.select(*cols, h.gpu_hours_per_1000(F.col("median_latency_s"), F.col("compute_class")).alias("gpu_hours_per_1000"), usd.alias("usd_per_1000"), h.cost_per_1000_correct(usd, F.col("acc")).alias("usd_per_1000_correct")))


@query("""WITH e AS (SELECT event_id, user_id, CASE WHEN event_id % 4 = 0 THEN value / 100 END AS ledger, CASE WHEN event_id % 3 = 0 THEN value / 90 END AS reported, CASE WHEN event_id % 2 = 0 THEN value / 80 END AS tokens, value / 70 AS estimate FROM events)
    SELECT event_id, round(coalesce(ledger, reported, tokens, estimate), 6) AS usd, CASE WHEN ledger IS NOT NULL THEN 'ledger' WHEN reported IS NOT NULL THEN 'provider_reported' WHEN tokens IS NOT NULL THEN 'tokens' ELSE 'token_estimate' END AS basis,
        round(((100 - event_id % 10 - event_id % 7) * 3.0 + (event_id % 10) * 3.75 + (event_id % 7) * 0.3 + greatest(event_id % 50, 80 - 100) * 15.0) / 1000000.0::DOUBLE, 9) AS price FROM e""")
def cost_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, v = F.col("event_id"), F.col("value")
    usd, basis = h.resolved_cost(F.when(e % 4 == 0, v / 100), F.when(e % 3 == 0, v / 90), F.when(e % 2 == 0, v / 80), v / 70)
    price = h.token_price(F.lit(100), h.billable_output(e % 50, F.lit(80), F.lit(100)), F.lit(3.0), F.lit(15.0), e % 10, e % 7)
    return table(spark, sf_dir, "events").select("event_id", F.round(usd, 6).alias("usd"), basis.alias("basis"), F.round(price, 9).alias("price"))


@query("""SELECT user_id, round(sum(CASE WHEN event_type = 'purchase' THEN value ELSE 1.5 END), 6) AS committed_usd, round(sum(value * (1 + event_id % 4)) / 3600, 6) AS gpu_hours, round(count(*)::DOUBLE / sum(value), 6) AS items_per_s,
    round(CASE WHEN count(*) FILTER (value > 480) = 0 THEN sum(event_id % 100)::DOUBLE / sum(value) END, 6) AS tokens_per_s FROM events GROUP BY user_id""")
def hardware_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    per = table(spark, sf_dir, "events").groupBy("user_id").agg(
        h.committed(F.when(F.col("event_type") == "purchase", "collected"), F.col("value"), F.lit(1.5)).alias("committed_usd"), h.gpu_hours(F.col("value"), 1 + e % 4).alias("gpu_hours"),
        F.count("*").alias("n"), F.sum("value").alias("s"), F.sum(e % 100).alias("tok"), F.count_if(F.col("value") > 480).alias("miss"),
    )
    items, tokens = h.rates(F.col("n"), F.col("s"), F.col("tok"), F.col("miss"))
    return rounded(per.select("user_id", "committed_usd", "gpu_hours", items.alias("items_per_s"), tokens.alias("tokens_per_s")))


@query(f"""{META}, x AS (SELECT task, f1, (release_date - DATE '2000-01-01') / 365.25::DOUBLE AS years FROM scores JOIN models USING (model)) SELECT task, round(regr_slope(f1, years) * 100, 6) AS points_per_year, count(*) AS n FROM x GROUP BY task""")
def time_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(g.time_slopes(scores(spark, sf_dir).join(F.broadcast(models(spark)), "model"), ["task"], "release_date", "f1"))


@query(f"""{META}, x AS (SELECT model, avg(f1) AS y, any_value(k) AS x FROM scores JOIN models USING (model) GROUP BY model),
    l AS (SELECT a.model, regr_slope(b.y, b.x) AS s FROM x a JOIN x b ON a.model <> b.model GROUP BY a.model) SELECT round(min(s), 6) AS low, round(max(s), 6) AS high FROM l""")
def leave_one_out_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scores(spark, sf_dir).join(F.broadcast(models(spark)), "model").groupBy("model").agg(F.avg("f1").alias("y"), F.max("k").alias("x"))
    return rounded(g.leave_one_out_slopes(rows, "model", "x", "y"))


_AVG_RANK = "rank() OVER (PARTITION BY {0} ORDER BY {1}) + (count(*) OVER (PARTITION BY {0}, {1}) - 1) / 2.0"


@query(f"""{META}, x AS (SELECT model, round(avg(f1), 9) AS y, any_value(k) AS x FROM scores JOIN models USING (model) GROUP BY model), o AS (SELECT a.model AS out, b.x, b.y FROM x a JOIN x b ON a.model <> b.model),
    rk AS (SELECT out, {_AVG_RANK.format('out', 'x')} AS a, {_AVG_RANK.format('out', 'y')} AS b FROM o), c AS (SELECT out, corr(a, b) AS r FROM rk GROUP BY out) SELECT round(min(r), 6) AS low, round(max(r), 6) AS high FROM c""")
def leave_one_out_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scores(spark, sf_dir).join(F.broadcast(models(spark)), "model").groupBy("model").agg(F.round(F.avg("f1"), 9).alias("y"), F.max("k").alias("x"))
    return rounded(g.leave_one_out_correlations(rows, "model", "x", "y"))


@query(f"""WITH x AS (SELECT 1 AS g, p_size AS x, p_retailprice AS y, p_partkey % 17 AS z FROM part), rk AS (SELECT {_AVG_RANK.format('g', 'x')} AS x, {_AVG_RANK.format('g', 'y')} AS y, {_AVG_RANK.format('g', 'z')} AS z FROM x),
    c AS (SELECT corr(x, y) AS xy, corr(x, z) AS xz, corr(y, z) AS yz FROM rk) SELECT round(xy, 6) AS rank_correlation, round((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 6) AS partial FROM c""")
def partial_rank_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").withColumn("z", F.col("p_partkey") % 17)
    return rounded(g.partial_rank_correlation(rows, "p_size", "p_retailprice", "z"))


@query("""WITH x AS (SELECT p_size - avg(p_size) OVER (PARTITION BY p_brand) AS x, p_retailprice - avg(p_retailprice) OVER (PARTITION BY p_brand) AS y FROM part) SELECT round(sum(x * y) / sum(x * x), 6) AS slope, count(*) AS n FROM x""")
def within_group_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(g.within_group_slope(table(spark, sf_dir, "part"), ["p_brand"], "p_size", "p_retailprice"))


@query(f"""{META}, b AS (SELECT task, model, f1 AS y, k * length(task) AS x FROM scores JOIN models USING (model)),
    c AS (SELECT task, x - avg(x) OVER (PARTITION BY task) - avg(x) OVER (PARTITION BY model) + avg(x) OVER () AS x, y - avg(y) OVER (PARTITION BY task) - avg(y) OVER (PARTITION BY model) + avg(y) OVER () AS y FROM b),
    s AS (SELECT sum(x * y) / sum(x * x) AS slope, sum(x * x) AS xx FROM c), e AS (SELECT task, sum(x * (y - slope * x)) AS e FROM c, s GROUP BY task)
    SELECT round(any_value(slope), 6) AS slope, round(sqrt(sum(e * e) / any_value(xx) ** 2), 6) AS cluster_error, count(*) AS clusters FROM e, s""")
def two_way_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scores(spark, sf_dir).join(F.broadcast(models(spark)), "model").select("task", "model", F.col("f1").alias("y"), (F.col("k") * F.length("task")).cast("double").alias("x"))
    return rounded(g.two_way_slope(rows, "task", "model", "x", "y"))


@query(f"""WITH {SQL_DECISIONS} SELECT model, round(avg(pred::DOUBLE - gold::DOUBLE), 6) AS shift, round(1 - regr_slope(pred::DOUBLE, gold::DOUBLE), 6) AS pull, round(avg((pred::DOUBLE - gold::DOUBLE) ** 2), 6) AS mse FROM dec WHERE task = 'size' GROUP BY model""")
def error_decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decisions(spark, sf_dir).filter("task = 'size' AND pred_num IS NOT NULL")
    return rounded(g.error_decomposition(rows, ["model"], "gold_num", "pred_num"))


@query(f"{SCORES} PIVOT (SELECT task, model, round(f1, 6) AS f1 FROM scores) ON model IN ('m1', 'm2', 'm3', 'm4', 'm5') USING first(f1) GROUP BY task")
def score_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(r.score_matrix(scores(spark, sf_dir), "task", "model", "f1", ["m1", "m2", "m3", "m4", "m5"]))


@query(f"WITH {SQL_DECISIONS} SELECT model, item_id, task AS label_field, gold, pred, parse_error FROM dec WHERE task IN ('toxic', 'quality')")
def wide_and_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """To a column for each field and back."""
    rows = decisions(spark, sf_dir).filter("kind = 'binary'")
    return r.long_predictions(r.wide_predictions(rows, ["toxic", "quality"]), ["toxic", "quality"]).drop("task")


@query(f"""WITH {SQL_DECISIONS}, {SQL_MODELS}, {SQL_TASKS}, c AS (SELECT model, task, array_to_string(list_sort(list(DISTINCT CASE WHEN id % 2 = 0 THEN 'canonical' ELSE 'sidecar' END)), ',') AS sources, count(*) AS n, count(*) FILTER (parse_error IS NULL) AS usable FROM dec WHERE NOT (model = 'm3' AND task = 'size') GROUP BY ALL)
    SELECT m.model, t.task, coalesce(sources, '') AS sources, coalesce(n, 0) AS n, coalesce(usable, 0) AS usable FROM models m CROSS JOIN tasks t LEFT JOIN c ON c.model = m.model AND c.task = t.task""")
def coverage_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decisions(spark, sf_dir).filter("NOT (model = 'm3' AND task = 'size')").withColumn("source", F.when(F.col("id") % 2 == 0, "canonical").otherwise("sidecar"))
    return api.coverage(rows, models(spark), tasks(spark))


@query(f"WITH {SQL_DECISIONS} SELECT count(*) AS rows, count(DISTINCT task) AS tasks, count(DISTINCT model) AS models, count(DISTINCT (task, model)) AS cells FROM dec")
def task_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.inventory(decisions(spark, sf_dir))


@query(f"""WITH {SQL_DECISIONS}, x AS (SELECT task, model, b, item_id, CASE WHEN b > 1 AND (id * 13 + b + k) % 11 = 0 THEN NULL WHEN b > 1 AND (id * 5 + b + k) % 9 = 0 THEN 'other' ELSE pred END AS p, pred AS one FROM dec, (VALUES (1), (10), (20)) v(b) WHERE kind <> 'score')
    SELECT task, model, b AS batch_size, round(CASE WHEN b = 1 THEN 1 ELSE avg((p = one)::INT) END, 6) AS agreement, count(*) FILTER (p IS NOT NULL AND one IS NOT NULL) AS compared FROM x GROUP BY task, model, b""")
def batch_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batched answers against single ones."""
    dec = answers(items_apart(spark, sf_dir)).filter("kind <> 'score'").drop("batch_size").withColumn("batch_size", F.explode(F.array(*map(F.lit, (1, 10, 20)))))
    b, k, id_ = F.col("batch_size"), F.col("k"), F.col("id")
    other = F.when((b > 1) & ((id_ * 13 + b + k) % 11 == 0), F.lit(None)).when((b > 1) & ((id_ * 5 + b + k) % 9 == 0), "other").otherwise(F.col("pred"))
    return rounded(api.batch_agreement(dec.withColumn("pred", other)))


def summary_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole summary; its columns are checked one by one by the scoring queries."""
    dec = decisions(spark, sf_dir).withColumn("latency_s", latency(F.col("k"), F.col("id")))
    return rounded(api.summarize(dec, label_def(spark), models(spark), score_range=(1.0, 50.0)))


def release_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The release's table of pairs, with the 2,000 replicates of a release; ``paired_bootstrap`` has the first 1,000 of them."""
    return rounded(api.release(decisions(spark, sf_dir), label_def(spark), tasks(spark), 2000)["pairs"])


query()(summary_report)
query()(release_pairs)


@query("""WITH v AS (SELECT vec_id, vec_id % 5 AS fold, label, i, embedding[i]::DOUBLE AS x FROM embeddings, range(1, 65) r(i)), s AS (SELECT label, i, fold, sum(x) AS s, count(*) AS n FROM v GROUP BY ALL),
    c AS (SELECT f.fold, label, i, sum(s) / sum(n) AS m FROM s JOIN (SELECT DISTINCT fold FROM v) f ON s.fold <> f.fold GROUP BY ALL),
    n AS (SELECT fold, label, i, m / sqrt(sum(m * m) OVER (PARTITION BY fold, label)) AS m FROM c), d AS (SELECT v.vec_id, n.label, round(sum(v.x * n.m), 9) AS dot FROM v JOIN n USING (fold, i) GROUP BY ALL)
    SELECT vec_id, arg_min(label, (-dot, label)) AS pred FROM d GROUP BY vec_id""")
def nearest_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector by the centroids of the folds that it isn't in."""
    rows = table(spark, sf_dir, "embeddings").withColumn("fold", F.col("vec_id") % 5)
    return u.nearest_centroid_out_of_fold(rows, "embedding", "label", "vec_id", "fold")
