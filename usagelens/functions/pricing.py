"""Model families, prices and per-record cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Public list prices, USD per million tokens times 1000.
# family: (input, output, cache read, cache write 5 min, cache write 1 h)
PRICE_MILLI = {
    "fable-5": (10000, 50000, 1000, 12500, 20000),
    "opus": (5000, 25000, 500, 6250, 10000),
    "sonnet": (3000, 15000, 300, 3750, 6000),
    "haiku": (1000, 5000, 100, 1250, 2000),
    "gpt-5.5": (5000, 30000, 500, 5000, 5000),
    "gpt-5.4": (2500, 15000, 250, 2500, 2500),
    "gpt-5-mini": (750, 4500, 75, 750, 750),
    "gpt-5-codex": (1750, 14000, 175, 1750, 1750),
    "unknown": (0, 0, 0, 0, 0),
}

PRICE_FIELDS = ("input", "output", "cache_read", "cache_write_5m", "cache_write_1h")


# Substrings that select a family, tested in this order; "^" marks a prefix.
# Every group of a rule must match, one alternative each.
FAMILY_RULES = (
    ("opus", [["opus"]]),
    ("sonnet", [["sonnet"]]),
    ("haiku", [["haiku"]]),
    ("fable-5", [["fable", "mythos"]]),
    ("gpt-5-codex", [["codex"]]),
    ("gpt-5-mini", [["mini"], ["gpt", "^o"]]),
    ("gpt-5.5", [["gpt-5.5", "gpt5.5"]]),
    ("gpt-5.4", [["gpt-5.4", "gpt5.4"]]),
    ("gpt-5.5", [["gpt", "^o1", "^o3", "^o4"]]),
)


def model_family(model: str = "model", *, lowered: bool = False) -> Column:
    """Price family of the model id in column `model`; the first matching rule wins."""
    m = model if lowered else f"lower({model})"

    def test(needle):
        return f"startswith({m}, '{needle[1:]}')" if needle.startswith("^") else f"contains({m}, '{needle}')"

    whens = " ".join(
        "WHEN " + " AND ".join("(" + " OR ".join(test(n) for n in group) + ")" for group in groups) + f" THEN '{family}'"
        for family, groups in FAMILY_RULES
    )
    return F.expr(f"CASE {whens} ELSE 'unknown' END")


_PRICE_MAP = "map(" + ", ".join(f"'{fam}', array({', '.join(f'{v}L' for v in p)})" for fam, p in PRICE_MILLI.items()) + ")"


def price_array(family: str = "family") -> Column:
    """Prices of a family, in PRICE_FIELDS order, from a constant map: nine rows do not
    need a join, and a lookup keeps generated code small where a CASE per price does not."""
    return F.expr(f"element_at({_PRICE_MAP}, {family})")


def price_milli(family: str, field: str) -> Column:
    return F.get(price_array(family), F.lit(PRICE_FIELDS.index(field)))


def price_struct(family: str) -> Column:
    return F.struct(*[price_milli(family, f).alias(f) for f in PRICE_FIELDS])


def cost_nano(cache_ttl: str = "5m", price: str = "_price") -> Column:
    """Exact cost of one record in nano-USD from its price array."""
    if cache_ttl not in ("5m", "1h"):
        raise ValueError(f"cache_ttl must be 5m or 1h, not {cache_ttl!r}")
    i = {f: f"get({price}, {n})" for n, f in enumerate(PRICE_FIELDS)}
    return F.expr(
        f"input_tokens * {i['input']} + output_tokens * {i['output']}"
        f" + cache_read_tokens * {i['cache_read']} + cache_creation_tokens * {i['cache_write_' + cache_ttl]}"
    )


def effective_tokens(cost: str = "cost_nano", price: str = "_price") -> Column:
    """Input-equivalent tokens (cost with five-minute cache writes over the input price),
    truncated per record; unknown families count input + output."""
    return F.expr(f"coalesce({cost} div nullif(get({price}, 0), 0L), input_tokens + output_tokens)")


def with_price(usage: DataFrame) -> DataFrame:
    """Add family and its price array, step by step so that each is computed once."""
    return (
        usage.withColumn("_model", F.lower("model"))
        .withColumn("family", model_family("_model", lowered=True))
        .withColumn("_price", price_array("family"))
    )


def cost_per_record(usage: DataFrame, cache_ttl: str = "5m", prices: DataFrame | None = None) -> DataFrame:
    """Add family and cost. With `prices` (family + the five milli columns) the built-in
    list is replaced; the join carries no hint, so its size decides how it runs."""
    df = with_price(usage)
    if prices is not None:
        p = prices.select("family", F.array(*PRICE_FIELDS).alias("_own"))
        zero = F.expr("array(0L, 0L, 0L, 0L, 0L)")
        df = df.join(p, "family", "left").withColumn("_price", F.coalesce("_own", zero)).drop("_own")
    return df.withColumn("cost_nano", cost_nano(cache_ttl)).drop("_model", "_price")
