"""Prices, stakes and orders as Column expressions. Money is decimal where cents must be exact."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def synthetic_price(p: Column) -> Column:
    """A venue price made up from a probability, drawn to the middle and kept in 0.02..0.98."""
    return F.greatest(F.lit(0.02), F.least(F.lit(0.98), 0.5 + (p - 0.5) * 0.8))


def has_edge(win: Column, price: Column, margin: float = 0.0) -> Column:
    return (price > 0) & (price < 1) & (win > price + margin)


def no_bet(p: Column, band: float = 0.04) -> Column:
    return F.abs(p - 0.5) * 2 < band


def full_kelly(win: Column, price: Column) -> Column:
    return F.when((price > 0) & (price < 1), (win - price) / (1 - price)).otherwise(0.0)


def truncated(c: Column, digits: int) -> Column:
    """Towards zero at ``digits`` decimals; a tiny lift undoes binary representation error."""
    return F.floor(c * 10**digits + 1e-7) / 10**digits


def kelly_sizer(q: Column, yes: Column, no: Column, available: Column, fraction: float) -> Column:
    """struct(trade, side, stake, shares, edge, price, reason) of the better side of a two-sided market.

    Either side is a candidate (edge, side, chance, price); the greatest edge wins, yes before no.
    """
    q = F.least(F.lit(1.0), F.greatest(F.lit(0.0), q))
    candidate = lambda side, win, price: F.struct((win - price).alias("edge"), F.lit(side).alias("side"), win.alias("win"), price.alias("price"))
    best = F.greatest(candidate("Yes", q, yes), candidate("No", 1 - q, no))
    found, usable = best["edge"] > 0, (best["price"] > 0) & (best["price"] < 1)
    stake = F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), full_kelly(best["win"], best["price"]) * fraction)) * available + 1e-9, 2)
    shares = truncated(stake / F.when(usable, best["price"]), 4)
    reason = F.when(~found, "no positive edge").when(~usable, "unusable price").when(stake <= 0, "stake rounds to zero").when(shares <= 0, "shares round to zero").otherwise("sized")
    trade = reason == "sized"
    return F.struct(
        trade.alias("trade"), F.when(found, best["side"]).otherwise("Yes").alias("side"), F.when(trade, stake).otherwise(0.0).alias("stake"), F.when(trade, shares).otherwise(0.0).alias("shares"),
        best["edge"].alias("edge"), F.when(found, best["price"]).otherwise(0.0).alias("price"), reason.alias("reason"),
    )


def tick_floor(price: Column, tick: Column) -> Column:
    """A decimal price down to its tick; as it is without a tick."""
    return F.when(tick > 0, F.floor(price / tick) * tick).otherwise(price)


def order_amounts(price: Column, size: Column, tick: Column, least: Column) -> Column:
    """struct(maker, taker, price) in millionths for a buy; NULL under the least size or tick. All arguments are decimals."""
    at = tick_floor(price, tick)
    ok = (at > 0) & ~((least > 0) & (size < least))
    return F.when(ok, F.struct(F.floor(at * size * 1_000_000).cast("long").alias("maker"), F.floor(size * 1_000_000).cast("long").alias("taker"), at.cast("double").alias("price")))


def alignment(windows_match: Column, source: Column, expected: Column) -> Column:
    blank = lambda c: c.isNull() | (F.trim(c) == "")
    return F.when(~windows_match | blank(source), "Mismatch").when(blank(expected), "Tolerated").when(F.lower(source) == F.lower(expected), "Exact").otherwise("Tolerated")


def ruin(p: Column, bankroll: Column, bet: Column) -> Column:
    """struct(lives, edge, p_ruin, safe_bet, verdict): risk of ruin at even money, and the bet for a 1 % risk."""
    q = 1 - p
    lives = F.when(bet > 0, F.floor(bankroll / bet)).otherwise(0)
    hopeless = p <= 0.5 + 1e-9
    risk = F.when(hopeless | (lives <= 0), 1.0).otherwise(F.pow(q / p, lives))
    n = F.when(~hopeless & (p < 1), F.log(F.lit(0.01)) / F.log(q / p))
    verdict = F.when(hopeless, "No edge").when(risk < 0.01, "Safe").when(risk < 0.05, "Aggressive").when(risk < 0.2, "Risky").otherwise("Gambling")
    return F.struct(lives.cast("long").alias("lives"), (2 * p - 1).alias("edge"), risk.alias("p_ruin"), (bankroll / F.ceil(n)).alias("safe_bet"), verdict.alias("verdict"))
