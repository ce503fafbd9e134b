"""Daily market features by ticker: returns, benchmark, volatility, averages, momentum, volume.

All windows are rows of one ticker in the order of days, so a whole feature set
costs one shuffle by ticker.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import clip, finite, safe_divide

YEAR = 252
CAP = 0.99


def _days(key: str = "ticker", day: str = "date"):
    return Window.partitionBy(key).orderBy(day)


def dedupe_days(df: DataFrame, key: str = "ticker", day: str = "date", sequence: str | None = None) -> DataFrame:
    """One row for each ticker and day: the last by ``sequence``, else the one whose values have the largest hash."""
    last = Window.partitionBy(key, day).orderBy(F.col(sequence).desc() if sequence else F.xxhash64(*df.columns).desc())
    return df.withColumn("__k", F.row_number().over(last)).filter("__k = 1").drop("__k")


def standardise_ohlcv(df: DataFrame, names: dict[str, str], ticker: str | None = None) -> DataFrame:
    """Renames columns, dates without time, tickers in upper case, a missing adjusted close from the close."""
    out = df.withColumnsRenamed(names)
    out = out.withColumn("date", F.to_date("date"))
    out = out.withColumn("ticker", F.upper(F.lit(ticker) if ticker else F.col("ticker")))
    close = F.coalesce("adj_close", "close") if "adj_close" in out.columns else F.col("close")
    return out.withColumn("adj_close", close)


def daily_returns(df: DataFrame, price: str = "adj_close", cap: float = CAP, pad: bool = True, out: str = "daily_return") -> DataFrame:
    """p / p before - 1 within +-``cap``.  ``pad``: a missing price counts as the one before."""
    w = _days()
    p = F.last(finite(price), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)) if pad else finite(price)
    return df.withColumn("__p", p).withColumn(out, clip(F.try_divide("__p", F.lag("__p").over(w)) - 1, -cap, cap)).drop("__p")


def forward_returns(df: DataFrame, horizons: list[int], price: str = "adj_close") -> DataFrame:
    """``return_Nd``: the price N rows ahead over today's, less 1."""
    w = _days()
    return df.withColumns({f"return_{n}d": F.try_divide(F.lead(price, n).over(w), F.col(price)) - 1 for n in horizons})


def benchmark_returns(benchmark: DataFrame, price: str = "close") -> DataFrame:
    """(date, benchmark_return) of one series; it has a row for each day, so one task orders it."""
    w = Window.orderBy("date")
    return benchmark.select("date", (F.try_divide(price, F.lag(price).over(w)) - 1).alias("benchmark_return"))


def join_benchmark(df: DataFrame, benchmark: DataFrame, cap: float | None = CAP) -> DataFrame:
    """Left join by day; of each run of days without a benchmark the first takes the value before it."""
    out = df.drop("benchmark_return").join(benchmark.select("date", "benchmark_return"), "date", "left")
    b = finite("benchmark_return")
    filled = F.coalesce(b, F.lag(b, 1).over(_days()))
    return out.withColumn("benchmark_return", clip(filled, -cap, cap) if cap else filled)


def abnormal_returns(df: DataFrame, horizons: list[int] | None = None) -> DataFrame:
    """Daily: stock less benchmark.  N days: ``return_Nd`` less today's benchmark return compounded N times."""
    out = df.withColumn("abnormal_return", F.col("daily_return") - F.col("benchmark_return"))
    return out.withColumns({f"abnormal_return_{n}d": F.col(f"return_{n}d") - (F.pow(1 + F.col("benchmark_return"), F.lit(n)) - 1) for n in horizons or []})


def car_from_horizons(df: DataFrame, sets: dict[str, list[int]]) -> DataFrame:
    """Sums of horizon returns; null if one is null."""
    return df.withColumns({name: sum((F.col(f"abnormal_return_{n}d") for n in ns[1:]), F.col(f"abnormal_return_{ns[0]}d")) for name, ns in sets.items()})


def rolling_volatility(df: DataFrame, window: int = 20, least: int = 10, out: str = "rolling_volatility_20d") -> DataFrame:
    """Yearly: the standard deviation of the last ``window`` returns times sqrt(252), from ``least`` values on."""
    f = _days().rowsBetween(-(window - 1), 0)
    return df.withColumn(out, F.when(F.count("daily_return").over(f) >= least, F.stddev_samp("daily_return").over(f) * F.sqrt(F.lit(float(YEAR)))))


def moving_averages(df: DataFrame, windows: list[int], price: str = "adj_close") -> DataFrame:
    return df.withColumns({f"sma_{n}": F.avg(finite(price)).over(_days().rowsBetween(-(n - 1), 0)) for n in windows})


def ema(df: DataFrame, span: int = 20, price: str = "adj_close", key: str = "ticker", order: str = "date", out: str | None = None) -> DataFrame:
    """e = a x + (1 - a) e before, a = 2 / (span + 1), from the first value: a fold over each ticker's days."""
    name = out or f"ema_{span}"

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        return pdf.assign(**{name: pdf[price].astype("float64").ewm(span=span, adjust=False).mean()})

    return df.groupBy(key).applyInPandas(fold, f"{df._jdf.schema().toDDL()}, `{name}` double")


def momentum(df: DataFrame, horizons: list[int], price: str = "adj_close") -> DataFrame:
    w = _days()
    return df.withColumns({f"momentum_{n}d": F.try_divide(F.col(price), F.lag(price, n).over(w)) - 1 for n in horizons})


def gap_and_range(df: DataFrame, price: str = "adj_close") -> DataFrame:
    """Open over the close before, less 1; high less low over the price, not below 0."""
    w = _days()
    return df.withColumns({"price_gap": F.try_divide("open", F.lag("close").over(w)) - 1, "intraday_range": F.greatest(F.try_divide(F.col("high") - F.col("low"), F.col(price)), F.lit(0.0))})


def volume_features(df: DataFrame, window: int = 20) -> DataFrame:
    """Change within [-10, 100]; volume over the mean of the ``window`` days before, within [0, 50]."""
    w = _days()
    before = F.avg("volume").over(w.rowsBetween(-window, -1))
    return df.withColumns({"volume_change": clip(F.try_divide("volume", F.lag("volume").over(w)) - 1, -10.0, 100.0), "relative_volume": clip(F.try_divide(F.col("volume"), before), 0.0, 50.0)})


def feature_set(df: DataFrame, benchmark: DataFrame | None = None, horizons: tuple[int, ...] = (1, 2, 3, 5)) -> DataFrame:
    """All features; the fold of the exponential average comes last."""
    out = forward_returns(daily_returns(df), list(horizons))
    out = join_benchmark(out, benchmark) if benchmark is not None else out
    out = abnormal_returns(out, list(horizons))
    known = [n for n in range(1, 6) if n in horizons]
    out = car_from_horizons(out, {"car_3d": [n for n in known if n <= 3], "car_5d": known})
    out = volume_features(gap_and_range(momentum(moving_averages(rolling_volatility(out), [20, 50]), [5, 20])))
    return ema(out)


def event_slice(df: DataFrame, event_date: str | Column, pre: int, post: int) -> DataFrame:
    """The rows ``pre`` before to ``post`` after the first day on or after the date, with ``relative_day``."""
    at = F.lit(event_date).cast("date") if isinstance(event_date, str) else event_date
    w = _days()
    out = df.withColumn("__n", F.row_number().over(w))
    out = out.withColumn("__at", F.min(F.when(F.col("date") >= at, F.col("__n"))).over(Window.partitionBy("ticker")))
    return out.withColumn("relative_day", F.col("__n") - F.col("__at")).filter(F.col("relative_day").between(-pre, post)).drop("__n", "__at")


def compound(returns: str) -> Column:
    """Aggregate: the product of 1 + r, less 1; a missing r counts as 0."""
    return F.product(1 + F.coalesce(finite(returns), F.lit(0.0))) - 1


def beta(stock: str = "daily_return", market: str = "benchmark_return", least: int = 30) -> Column:
    """Aggregate: covariance over variance on days with both; 1 under ``least`` of them."""
    both = F.col(stock).isNotNull() & F.col(market).isNotNull()
    s, m = F.when(both, F.col(stock)), F.when(both, F.col(market))
    return F.when(F.count(s) < least, 1.0).otherwise(F.coalesce(F.try_divide(F.covar_samp(s, m), F.var_samp(m)), F.lit(1.0)))


def per_event_market(market: DataFrame, key: str = "transcript_id") -> DataFrame:
    """One row for each event (a null key is one): rows, first and last day, mean and deviation of returns, extremes."""
    return market.groupBy(key).agg(
        F.count("*").alias("market_rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.avg("daily_return").alias("mean_return"), F.stddev_samp("daily_return").alias("std_return"),
        F.avg("volume").alias("mean_volume"), F.min("low").alias("min_low"), F.max("high").alias("max_high"),
    )


def return_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each column: count, mean, median, deviation, extremes, share above 0."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), finite(c).alias("x")) for c in columns])).alias("m")).select("m.*")
    return long.groupBy("metric").agg(
        F.count("x").alias("n"), F.count_if(F.col("x").isNull()).alias("n_missing"), F.avg("x").alias("mean"), F.median("x").alias("median"),
        F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"), F.coalesce(safe_divide(F.count_if(F.col("x") > 0), F.count("x")), F.lit(0.0)).alias("pct_positive"),
    )
