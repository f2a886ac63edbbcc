"""Cost, latency and hardware accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbering import running_sum
from .quantiles import exact_quantiles


def gpu_hours_per_1000(median_latency: Column, compute_class: Column) -> Column:
    """Of local models only."""
    return F.when(compute_class == "local", median_latency * 1000 / 3600)


def usd_per_1000(cost_per_call: Column) -> Column:
    return cost_per_call * 1000


def cost_per_1000_correct(usd: Column, accuracy: Column) -> Column:
    return F.try_divide(usd, accuracy)


def resolved_cost(ledger: Column, reported: Column, tokens: Column, estimate: Column) -> tuple[Column, Column]:
    """The best evidence there is, and which it was."""
    basis = F.when(ledger.isNotNull(), "ledger").when(reported.isNotNull(), "provider_reported").when(tokens.isNotNull(), "tokens").when(estimate.isNotNull(), "token_estimate")
    return F.coalesce(ledger, reported, tokens, estimate), basis


def billable_output(completion: Column, total: Column, prompt: Column) -> Column:
    return F.greatest(completion, total - prompt)


def token_price(prompt: Column, output: Column, usd_in: Column, usd_out: Column, cache_write: Column | None = None, cache_read: Column | None = None, discount: float = 1.0) -> Column:
    """USD at prices per million tokens; cache writes cost 1.25 and reads 0.1 of the input price."""
    zero = F.lit(0)
    w, r = (F.coalesce(c if c is not None else zero, zero) for c in (cache_write, cache_read))
    return ((prompt - w - r) * usd_in + w * usd_in * 1.25 + r * usd_in * 0.1 + output * usd_out) / 1_000_000 * discount


def worst_case_usd(body: Column, max_output: Column, usd_in: Column, usd_out: Column, margin: float = 1.2) -> Column:
    """A bound before sending: a token has one byte at least."""
    return (F.octet_length(body) * usd_in + max_output * usd_out) / 1_000_000 * margin


def within_budget(rows: DataFrame, priority: str, cost: str, budget: float) -> DataFrame:
    """What is kept when items are added by priority (a whole number) until the budget is used up."""
    out = running_sum(rows, priority, cost, "spent")
    return out.withColumn("kept", F.round("spent", 6) <= budget)


def committed(status: Column, cost: Column, reserved: Column) -> Column:
    """Actual cost once collected, else the reservation."""
    return F.sum(F.when(status == "collected", cost).otherwise(reserved))


def gpu_hours(elapsed_s: Column, gpus: Column) -> Column:
    """Over every attempt, failed ones too."""
    return F.sum(elapsed_s * gpus) / 3600


def rates(items: Column, seconds: Column, tokens: Column, missing: Column) -> tuple[Column, Column]:
    """Items and tokens per second; tokens are unknown where usage is missing."""
    return F.try_divide(items.cast("double"), seconds), F.when(missing == 0, F.try_divide(tokens.cast("double"), seconds))


def per_item_latency(batch_latency: Column, batch_items: Column) -> Column:
    return F.try_divide(batch_latency, batch_items.cast("double"))


def latency_summary(rows: DataFrame, by: str, latency: str, error: str) -> DataFrame:
    """Failed answers count where they have a latency. Quantiles are exact, and no model's latencies meet in one task."""
    middle = exact_quantiles(rows, [by], latency, {"median_latency_s": 0.5, "p90_latency_s": 0.9})
    out = rows.groupBy(by).agg(F.count("*").alias("n"), F.avg(latency).alias("mean_latency_s"), F.count_if(F.col(error).isNotNull()).alias("errors")).join(middle, by)
    median = F.col("median_latency_s")
    return out.withColumns({"items_per_minute": F.try_divide(F.lit(60.0), median), "minutes_per_1000": median * 1000 / 60})


def comparable_groups(rows: DataFrame, key: list[str], gpu: str) -> DataFrame:
    """Groups with the same texts and settings on one kind of hardware."""
    return rows.groupBy(*key).agg(F.countDistinct(gpu).alias("_g"), F.count("*").alias("models"), F.min(gpu).alias("gpu")).filter("_g = 1 AND models > 1").drop("_g")


def ledger_cost_per_1000(rows: DataFrame, run: str, hour: str, usd: str, peak: tuple[int, int], factor: float) -> DataFrame:
    """Ledger amounts of a run per 1,000 items; from the first peak hour on, up to the last, they count ``factor`` times."""
    busy = (F.col(hour) >= peak[0]) & (F.col(hour) < peak[1])
    return rows.groupBy(run).agg((F.sum(F.when(busy, factor).otherwise(1.0) * F.col(usd)) / F.count("*") * 1000).alias("usd_per_1000"))


def preflight(requests: DataFrame, max_output: int, usd_in: float, usd_out: float, margin: float = 1.2, by: str = "task") -> DataFrame:
    """Bounds on what requests (``user_content``) can use and cost, at prices per million tokens."""
    size = F.sum(F.octet_length("user_content"))
    out = requests.groupBy(by).agg(F.count("*").alias("requests"), size.alias("prompt_bound"), (F.count("*") * max_output).alias("output_bound"))
    return out.withColumn("usd_bound", (F.col("prompt_bound") * usd_in + F.col("output_bound") * usd_out) / 1_000_000 * margin)


def at_standard_rate(usd: Column, batch: Column, discount: float = 0.5) -> Column:
    """Costs as if nothing had been sent at the discount of a batch."""
    return F.when(batch, usd / discount).otherwise(usd)
