"""Token prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordmill.fixed import DEFAULT_PROVIDER, FALLBACK_PROVIDER, PROVIDERS
from recordmill.functions.text import py_round
from recordmill.session import small_table


def priced(prompt: str, completion: str, input_price: str, output_price: str) -> Column:
    """USD for a token count at prices per million, 6 digits."""
    return py_round(
        f"((cast({prompt} as double) / 1000000.0D) * {input_price} + (cast({completion} as double) / 1000000.0D)"
        f" * {output_price})", 6)


def price_of(key: str) -> tuple[float, float]:
    """Input and output price; unknown names have the fallback provider's."""
    prices = {p[0]: (p[3], p[4]) for p in PROVIDERS}
    return prices.get(key, prices[FALLBACK_PROVIDER])


def cost(prompt: str, completion: str, provider: str = DEFAULT_PROVIDER) -> Column:
    """Cost at one provider named when the plan is built."""
    input_price, output_price = price_of(provider)
    return priced(prompt, completion, f"{input_price}D", f"{output_price}D")


def providers(spark: SparkSession, active: str = DEFAULT_PROVIDER) -> DataFrame:
    """Price list in listing order with the active one marked."""
    rows = [(i, *p, p[0] == active) for i, p in enumerate(PROVIDERS)]
    names = ["position", "key", "name", "model", "input", "output", "free", "active"]
    return small_table(spark, names, rows)


def cost_by_provider_column(rows: DataFrame, provider_column: str) -> DataFrame:
    """Add ``cost_usd`` at the provider each row names; unknown names use the fallback price."""
    prices = providers(rows.sparkSession).select(
        F.col("key").alias(provider_column), F.col("input").alias("_in"), F.col("output").alias("_out")
    )
    free_in, free_out = price_of(FALLBACK_PROVIDER)
    return rows.join(prices, provider_column, "left").withColumn("cost_usd", priced(
        "prompt_tokens", "completion_tokens", f"coalesce(_in, {free_in}D)", f"coalesce(_out, {free_out}D)",
    )).drop("_in", "_out")
