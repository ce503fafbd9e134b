"""Guarded arithmetic, clipping, rounding and label rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Name = str | Column


def col(c: Name) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Name) -> Column:
    """NaN and infinities become null, which is how missing numbers are kept."""
    c = col(c).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def safe_divide(a: Name, b: Name, default: float | None = 0.0) -> Column:
    """a / b; ``default`` where either is missing or not finite, or b is 0."""
    got = finite(F.try_divide(finite(a), finite(b)))
    return got if default is None else F.coalesce(got, F.lit(float(default)))


def clip(c: Name, low: float, high: float) -> Column:
    """Between the bounds; null stays null."""
    c = col(c)
    return F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(high)), F.lit(low)))


def clip_score(c: Name, low: float = -1.0, high: float = 1.0) -> Column:
    """As ``clip``, but what isn't finite becomes the lower bound."""
    return F.coalesce(clip(finite(c), low, high), F.lit(low))


def half_even(c: Name, digits: int = 6) -> Column:
    return F.bround(col(c), digits)


def to_number(c: Name) -> Column:
    """A double, null where the text isn't a number."""
    return finite(col(c).cast("string").try_cast("double"))


def truthy(c: Name) -> Column:
    """Yes/no words, digits and booleans as a boolean; null for anything else."""
    t = F.lower(F.trim(col(c).cast("string")))
    return F.when(t.isin("true", "yes", "y", "1", "1.0", "t"), True).when(t.isin("false", "no", "n", "0", "0.0", "f"), False)


def label_strict(c: Name, threshold: float = 0.05, missing: str = "unknown") -> Column:
    """positive above the threshold, negative below its opposite, else neutral."""
    c = col(c)
    return F.when(c.isNull(), missing).when(c > threshold, "positive").when(c < -threshold, "negative").otherwise("neutral")


def label_inclusive(c: Name, threshold: float = 0.02, missing: str = "unknown") -> Column:
    c = col(c)
    return F.when(c.isNull(), missing).when(c >= threshold, "positive").when(c <= -threshold, "negative").otherwise("neutral")


def direction(c: Name) -> Column:
    """By sign alone; null stays null."""
    c = col(c)
    return F.when(c > 0, "positive").when(c < 0, "negative").when(c == 0, "neutral")


def tone(positive: Name, negative: Name, alpha: float = 0.0) -> Column:
    """(p - n) / (p + n + 2 alpha), 0 where nothing was matched, within [-1, 1]."""
    p, n = col(positive).cast("double"), col(negative).cast("double")
    return clip(safe_divide(p - n, p + n + 2 * alpha), -1.0, 1.0)


def ratio01(a: Name, b: Name) -> Column:
    return clip(safe_divide(a, b), 0.0, 1.0)


def normalise_probs(*cs: Name) -> list[Column]:
    """Scaled to a sum of 1; equal shares where the sum is next to nothing."""
    cs = [F.greatest(F.coalesce(col(c), F.lit(0.0)), F.lit(0.0)) for c in cs]
    total = sum(cs[1:], cs[0])
    return [F.when(total < 1e-9, 1.0 / len(cs)).otherwise(F.try_divide(c, total)) for c in cs]


def normalise_vector(arr: Name) -> Column:
    """Array scaled to a sum of 1; negatives count as 0, and all zeros stay zeros."""
    pos = F.transform(col(arr), lambda x: F.greatest(F.coalesce(finite(x), F.lit(0.0)), F.lit(0.0)))
    total = F.aggregate(pos, F.lit(0.0), lambda a, x: a + x)
    return F.transform(pos, lambda x: F.coalesce(F.try_divide(x, total), F.lit(0.0)))


def weighted_mean(value: Name, weight: Name, floor: float = 1e-9, empty: float | None = 0.0) -> Column:
    """Aggregate: sum(v w) / sum(w); the plain mean where the weights sum to less than ``floor``."""
    v, w = finite(value), finite(weight)
    both = v.isNotNull() & w.isNotNull()
    total = F.sum(F.when(both, w))
    got = F.when(total < floor, F.avg(v)).otherwise(F.try_divide(F.sum(F.when(both, v * w)), total))
    return got if empty is None else F.coalesce(got, F.lit(empty))


def positive_weighted_mean(value: Name, weight: Name, default: float = 0.0) -> Column:
    """Aggregate over rows with a finite value and a weight above 0."""
    v, w = finite(value), finite(weight)
    ok = v.isNotNull() & (w > 0)
    return F.coalesce(F.try_divide(F.sum(F.when(ok, v * w)), F.sum(F.when(ok, w))), F.lit(default))


def std_or_zero(c: Name) -> Column:
    return F.coalesce(F.stddev_samp(finite(c)), F.lit(0.0))


def upper_median(c: Name) -> Column:
    """The element at n // 2 of the sorted values."""
    s = F.sort_array(F.collect_list(finite(c)))
    return F.coalesce(F.get(s, F.floor(F.size(s) / 2).cast("int")), F.lit(0.0))


def index_iqr(c: Name) -> Column:
    """sorted[3n // 4] - sorted[n // 4]; 0 under four values."""
    s = F.sort_array(F.collect_list(finite(c)))
    n = F.size(s)
    return F.when(n < 4, 0.0).otherwise(F.get(s, F.floor(3 * n / 4).cast("int")) - F.get(s, F.floor(n / 4).cast("int")))


def corr_guarded(x: Name, y: Name, least: int = 2) -> Column:
    """Pearson's r over rows where both are present; null under ``least`` rows or where one is constant."""
    x, y = finite(x), finite(y)
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    r = F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b))
    return F.when(F.count(a) >= least, clip(r, -1.0, 1.0))


def skew_corrected(c: Name) -> Column:
    """Bias-corrected skewness; null under three values."""
    n = F.count(finite(c))
    return F.when(n >= 3, F.skewness(finite(c)) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0)))


def kurtosis_corrected(c: Name) -> Column:
    """Bias-corrected excess kurtosis; null under four values."""
    n = F.count(finite(c)).cast("double")
    g = F.kurtosis(finite(c))
    return F.when(n >= 4, F.try_divide((n - 1) * ((n + 1) * g + 6), (n - 2) * (n - 3)))
