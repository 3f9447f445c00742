"""Exact money and token arithmetic."""

from __future__ import annotations

from collections.abc import Mapping
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Prices, the tier's limit and what a request takes.
MONEY = "decimal(38,12)"
#: USD a million tokens: input, cached input, cache write, output; a second row holds above long_from input tokens.
PRICES: Mapping[str, tuple[tuple[str, str, str, str], tuple[str, str, str, str]]] = {
    "model_a": (("0.20", "0.02", "0.25", "1.20"), ("0.40", "0.04", "0.50", "1.80")),
    "model_b": (("2.00", "0.20", "2.50", "12.00"), ("4.00", "0.40", "5.00", "18.00")),
}
LONG_FROM = 272_000
CHARS_A_TOKEN_TENTHS = 24
REQUEST_OVERHEAD = 300


def _rates(model: Column, tokens: Column, prices: Mapping) -> list[Column]:
    out = []
    for k in range(4):
        rate = F.lit(None).cast("decimal(10,4)")
        for name, (short, long) in prices.items():
            tier = F.when(tokens > LONG_FROM, F.lit(Decimal(long[k]))).otherwise(F.lit(Decimal(short[k])))
            rate = F.when(model == name, tier.cast("decimal(10,4)")).otherwise(rate)
        out.append(rate)
    return out


def _per_million(tokens: Column, rate: Column) -> Column:
    return (tokens.cast("decimal(18,0)") * rate).cast("decimal(28,4)")


def cost(model: Column, tokens: Column, cached: Column, written: Column, output: Column, prices: Mapping = PRICES) -> Column:
    """USD of a call; null for a model without a price and for more cached and written tokens than input."""
    r = _rates(model, tokens, prices)
    plain = tokens - cached - written
    total = _per_million(plain, r[0]) + _per_million(cached, r[1]) + _per_million(written, r[2]) + _per_million(output, r[3])
    return F.when(plain >= 0, (total.cast("decimal(32,6)") / F.lit(Decimal(1_000_000))).cast(MONEY))


def conservative_cost(model: Column, tokens: Column, most_output: Column, prices: Mapping = PRICES) -> Column:
    """USD that a call can't exceed: all input at its dearest rate and the longest output."""
    r = _rates(model, tokens, prices)
    total = _per_million(tokens, F.greatest(r[0], r[2])) + _per_million(most_output, r[3])
    return (total.cast("decimal(32,6)") / F.lit(Decimal(1_000_000))).cast(MONEY)


def with_overrides(rows: DataFrame, overrides: DataFrame, prices: DataFrame, model: str, columns: tuple[str, ...]) -> DataFrame:
    """rows with the columns of the override for their model, else of the price table; null, and priced false, without either."""
    over = overrides.select(model, F.struct(*columns).alias("_over"))
    base = prices.select(model, F.struct(*columns).alias("_base"))
    joined = rows.join(F.broadcast(over), model, "left").join(F.broadcast(base), model, "left")  # a row a model
    found = F.coalesce("_over", "_base")
    return joined.withColumns({c: found[c] for c in columns} | {"priced": found.isNotNull()}).drop("_over", "_base")


def preflight(model: Column, chars: Column, most_output: Column, most_input: int, prices: Mapping = PRICES) -> Column:
    """struct(tokens, cost, tier, too_large) of a request before it is made; the cost is what it can't exceed."""
    tokens = request_tokens(chars)
    tier = F.when(tokens > LONG_FROM, "long").otherwise("standard")
    return F.struct(tokens.alias("tokens"), conservative_cost(model, tokens, most_output, prices).alias("cost"), tier.alias("tier"), (tokens > most_input).alias("too_large"))


def request_tokens(chars: Column) -> Column:
    """Upper estimate of a request's tokens: ceil(chars / 2.4) and the overhead."""
    return F.floor((chars * 10 + CHARS_A_TOKEN_TENTHS - 1) / CHARS_A_TOKEN_TENTHS).cast("long") + REQUEST_OVERHEAD


def ledger_count(c: Column) -> Column:
    """Tokens as the ledger takes them: missing and negative ones are 0."""
    return F.when(c >= 0, c).otherwise(F.lit(0)).cast("long")


def ceil_product(*factors: Column) -> Column:
    product = factors[0].cast("decimal(18,6)")
    for f in factors[1:]:
        product = (product * f.cast("decimal(18,6)")).cast("decimal(36,12)")
    return F.ceil(product).cast("long")
