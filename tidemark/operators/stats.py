"""Statistics in closed form from moments: correlations, tests, intervals, buckets, regression."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distributions import Z_975, t_critical, t_pvalue
from ..functions.scalar import clip, corr_guarded, finite, kurtosis_corrected, safe_divide, skew_corrected

PERCENTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def describe(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """A row for each column (and group): count, missing, moments, extremes and interpolated percentiles."""
    long = df.select(*(by or []), F.explode(F.array(*[F.struct(F.lit(c).alias("column"), finite(c).alias("x")) for c in columns])).alias("m")).select(*(by or []), "m.*")
    out = long.groupBy(*(by or []), "column").agg(
        F.count("x").alias("n"), F.count_if(F.col("x").isNull()).alias("missing"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"),
        skew_corrected("x").alias("skew"), kurtosis_corrected("x").alias("kurtosis"), F.percentile("x", F.array(*[F.lit(p) for p in PERCENTILES])).alias("__p"),
    )
    return out.withColumns({f"p{round(p * 100):02d}": F.get("__p", F.lit(i)) for i, p in enumerate(PERCENTILES)}).drop("__p")


def group_statistics(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n"), *[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("median", F.median), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))])


def _pairs(df: DataFrame, xs: list[str], ys: list[str]) -> DataFrame:
    pairs = [F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), finite(x).alias("a"), finite(y).alias("b")) for x, y in itertools.product(xs, ys) if x != y]
    return df.select(F.explode(F.array(*pairs)).alias("m")).select("m.*").filter("a is not null and b is not null")


def _with_p(r: DataFrame) -> DataFrame:
    n = F.col("n").cast("double")
    t = F.when(F.abs("r") < 1, F.col("r") * F.sqrt(F.try_divide(n - 2, 1 - F.col("r") * F.col("r"))))
    out = r.withColumns({"p_value": F.when(F.abs("r") >= 1, 0.0).otherwise(t_pvalue(t.cast("double"), (n - 2).cast("double")))})
    return out.withColumns({"ci_low": fisher("r", "n", -1), "ci_high": fisher("r", "n", 1)})


def fisher(r: str, n: str, side: int) -> Column:
    """A bound of the 95 % interval of r; null under four rows or where |r| is 1."""
    ok = (F.col(n) >= 4) & (F.abs(r) < 1)
    z = F.when(ok, F.atanh(r)) + side * F.lit(Z_975) / F.sqrt(F.when(ok, F.col(n) - 3))
    return F.tanh(z)


def correlations(df: DataFrame, xs: list[str], ys: list[str], least: int = 3) -> DataFrame:
    """(x, y, n, r, p_value, ci_low, ci_high) over rows that have both."""
    r = _pairs(df, xs, ys).groupBy("x", "y").agg(F.count("*").alias("n"), corr_guarded("a", "b", least).alias("r"))
    return _with_p(r)


def average_rank(c: str, partition: list[str]) -> Column:
    """1-based; ties share the mean of their ranks; null stays null."""
    w = Window.partitionBy(*partition)
    return F.when(F.col(c).isNotNull(), F.rank().over(w.orderBy(F.col(c).asc_nulls_last())) + (F.count("*").over(Window.partitionBy(*partition, c)) - 1) / 2.0)


def spearman(df: DataFrame, xs: list[str], ys: list[str], least: int = 3) -> DataFrame:
    """Pearson's r of the average ranks.

    A pair's ranks take one ordered pass over all its rows, as exact ranks do.
    """
    p = _pairs(df, xs, ys)
    ranked = p.withColumns({"ra": average_rank("a", ["x", "y"]), "rb": average_rank("b", ["x", "y"])})
    return _with_p(ranked.groupBy("x", "y").agg(F.count("*").alias("n"), corr_guarded("ra", "rb", least).alias("r")))


def guarded_correlation(df: DataFrame, x: str, y: str, least: int = 3) -> DataFrame:
    """One row (n, r, status): insufficient_sample_size, constant_input or ok."""
    a, b = finite(x), finite(y)
    both = a.isNotNull() & b.isNotNull()
    p, q = F.when(both, a), F.when(both, b)
    out = df.agg(F.count(p).alias("n"), corr_guarded(x, y, least).alias("r"), (F.count_distinct(p) < 2).alias("__c"), (F.count_distinct(q) < 2).alias("__d"))
    return out.withColumn("status", F.when(F.col("n") < least, "insufficient_sample_size").when(F.col("__c") | F.col("__d"), "constant_input").otherwise("ok")).drop("__c", "__d")


def _moments(df: DataFrame, value: str, flag: Column) -> list[Column]:
    x = finite(value)
    a, b = F.when(flag, x), F.when(~flag, x)
    return [F.count(a).alias("n1"), F.count(b).alias("n2"), F.avg(a).alias("m1"), F.avg(b).alias("m2"), F.var_samp(a).alias("v1"), F.var_samp(b).alias("v2")]


def welch_t(df: DataFrame, value: str, flag: Column, alpha: float = 0.05) -> DataFrame:
    """One row: both groups' moments, t, degrees of freedom, p, the interval of the difference and Cohen's d."""
    m = df.filter(flag.isNotNull()).agg(*_moments(df, value, flag))
    e1, e2 = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    out = m.withColumns({"difference": F.col("m1") - F.col("m2"), "se": F.sqrt(e1 + e2)})
    out = out.withColumns({"t": F.try_divide("difference", "se"), "df": F.try_divide((e1 + e2) * (e1 + e2), e1 * e1 / (F.col("n1") - 1) + e2 * e2 / (F.col("n2") - 1))})
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / (F.col("n1") + F.col("n2") - 2))
    out = out.withColumns({"p_value": t_pvalue("t", "df"), "cohens_d": safe_divide("difference", pooled)})
    half = t_critical(F.lit(1 - alpha / 2), F.col("df")) * F.col("se")
    return out.withColumns({"ci_low": F.col("difference") - half, "ci_high": F.col("difference") + half})


def one_sample_t(df: DataFrame, value: str, mean: float = 0.0, alpha: float = 0.05) -> DataFrame:
    x = finite(value)
    out = df.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"))
    out = out.withColumn("se", F.try_divide(F.col("std"), F.sqrt("n")))
    out = out.withColumns({"t": F.try_divide(F.col("mean") - mean, "se"), "df": (F.col("n") - 1).cast("double")})
    half = t_critical(F.lit(1 - alpha / 2), F.col("df")) * F.col("se")
    return out.withColumns({"p_value": t_pvalue("t", "df"), "ci_low": F.col("mean") - half, "ci_high": F.col("mean") + half})


def paired_t(df: DataFrame, a: str, b: str) -> DataFrame:
    return one_sample_t(df.withColumn("__d", finite(a) - finite(b)), "__d")


def quantile_buckets(df: DataFrame, column: str, n: int = 5, out: str = "bucket", prefix: str = "Q") -> DataFrame:
    """Right-closed buckets between interpolated quantiles, repeated edges once; the least value is in the first.

    With a single edge left the range is cut into equal widths.
    """
    x = finite(column)
    edges = df.agg(F.percentile(x, F.array(*[F.lit(i / n) for i in range(n + 1)])).alias("e"))
    edges = edges.select(F.array_sort(F.array_distinct("e")).alias("__e"))
    both = df.join(F.broadcast(edges))  # one row of edges
    inner = F.slice("__e", 2, F.greatest(F.size("__e") - 2, F.lit(0)))
    place = F.size(F.filter(inner, lambda e: x > e)) + 1
    return both.withColumn(out, F.when(x.isNotNull() & (F.size("__e") >= 2), F.concat(F.lit(prefix), place.cast("string")))).drop("__e")


def percentile_rank(df: DataFrame, column: str, out: str = "percentile_rank") -> DataFrame:
    """Average rank over the number of values, times 100; null stays null.

    Exact ranks over one column need its rows in one order.
    """
    n = F.count(finite(column)).over(Window.partitionBy())
    return df.withColumn(out, average_rank(column, []) / n * 100)


def z_scores(df: DataFrame, columns: list[str], suffix: str = "_z") -> DataFrame:
    """(x - mean) / sample deviation; null where the deviation is 0.  The moments are one aggregated row."""
    m = df.agg(*[f(finite(c)).alias(f"__{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    out = df.join(F.broadcast(m))
    return out.withColumns({f"{c}{suffix}": F.try_divide(finite(c) - F.col(f"__m_{c}"), F.col(f"__s_{c}")) for c in columns}).drop(*m.columns)


def winsorise(df: DataFrame, column: str, low: float = 0.01, high: float = 0.99, out: str | None = None) -> DataFrame:
    x = finite(column)
    p = df.agg(F.percentile(x, F.array(F.lit(low), F.lit(high))).alias("__p"))
    both = df.join(F.broadcast(p))
    return both.withColumn(out or column, F.when(x.isNotNull(), F.least(F.greatest(x, F.get("__p", F.lit(0))), F.get("__p", F.lit(1))))).drop("__p")


def simple_ols(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """slope, intercept, r2 (0 to 1; 0 where y is flat), standard error and p of the slope, by group."""
    a, b = finite(x), finite(y)
    both = a.isNotNull() & b.isNotNull()
    p, q = F.when(both, a), F.when(both, b)
    g = df.groupBy(*(by or [])).agg(F.count(p).alias("n"), F.var_pop(p).alias("sxx"), F.var_pop(q).alias("syy"), F.covar_pop(p, q).alias("sxy"), F.avg(p).alias("mx"), F.avg(q).alias("my"))
    out = g.withColumn("slope", F.coalesce(F.try_divide("sxy", "sxx"), F.lit(0.0)))
    out = out.withColumns({"intercept": F.col("my") - F.col("slope") * F.col("mx"), "r2": clip(F.coalesce(F.try_divide(F.col("sxy") * F.col("sxy"), F.col("sxx") * F.col("syy")), F.lit(0.0)), 0.0, 1.0)})
    rest = F.greatest(F.col("syy") - F.col("slope") * F.col("sxy"), F.lit(0.0)) * F.col("n")
    out = out.withColumn("stderr", F.when(F.col("n") > 2, F.sqrt(F.try_divide(F.try_divide(rest, F.col("n") - 2), F.col("sxx") * F.col("n")))))
    t = F.try_divide("slope", "stderr")
    return out.withColumn("p_value", t_pvalue(t, (F.col("n") - 2).cast("double"))).select(*(by or []), "n", "slope", "intercept", "r2", "stderr", "p_value")


def ols(df: DataFrame, target: str, features: list[str]) -> DataFrame:
    """(term, coefficient, stderr, t, p_value, n, status): least squares from the sums of products of complete rows.

    One aggregated row of sums is solved; under len(features) + 2 rows or where
    the features are collinear only the status is told.
    """
    import numpy as np
    import pandas as pd

    cols = [F.lit(1.0), *[finite(f) for f in features]]
    y = finite(target)
    full = df.select(*[c.alias(f"x{i}") for i, c in enumerate(cols)], y.alias("y")).na.drop()
    k = len(cols)
    sums = [F.coalesce(F.sum(F.col(f"x{i}") * F.col(f"x{j}")), F.lit(0.0)).alias(f"s{i}_{j}") for i in range(k) for j in range(i, k)]
    sums += [F.coalesce(F.sum(F.col(f"x{i}") * F.col("y")), F.lit(0.0)).alias(f"t{i}") for i in range(k)] + [F.coalesce(F.sum(F.col("y") * F.col("y")), F.lit(0.0)).alias("yy"), F.count("*").alias("n")]
    names = ["intercept", *features]

    def solve(batches):
        for pdf in batches:
            for r in pdf.to_dict("records"):
                n = int(r["n"])
                a = np.array([[r[f"s{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float)
                b = np.array([r[f"t{i}"] for i in range(k)], float)
                status = "ok" if n >= k + 1 else "insufficient_sample_size"
                if status == "ok" and np.linalg.matrix_rank(a) < k:
                    status = "collinear_features"
                if status == "ok":
                    inv = np.linalg.inv(a)
                    coef = inv @ b
                    s2 = max(r["yy"] - coef @ b, 0.0) / (n - k) if n > k else np.nan
                    se = np.sqrt(np.diag(inv) * s2)
                else:
                    coef = se = np.full(k, np.nan)
                yield pd.DataFrame({"term": names, "coefficient": coef, "stderr": se, "n": n, "k": k, "status": status})

    out = full.agg(*sums).mapInPandas(solve, "term string, coefficient double, stderr double, n long, k long, status string")
    out = out.withColumns({c: finite(c) for c in ("coefficient", "stderr")})
    out = out.withColumn("t", F.try_divide("coefficient", "stderr"))
    return out.withColumn("p_value", t_pvalue("t", (F.col("n") - F.col("k")).cast("double"))).drop("k")


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """(bin, n) of equal widths between the extremes, the last bin closed."""
    x = finite(column)
    m = df.agg(F.min(x).alias("__a"), F.max(x).alias("__b"))
    b = F.least(F.floor(F.try_divide((x - F.col("__a")) * bins, F.col("__b") - F.col("__a"))), F.lit(bins - 1))
    return df.join(F.broadcast(m)).filter(x.isNotNull()).groupBy(F.coalesce(b, F.lit(0)).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def median_fill(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing numbers become the column's exact median, 0 where it has none."""
    m = df.agg(*[F.coalesce(F.median(finite(c)), F.lit(0.0)).alias(f"__{c}") for c in columns])
    return df.join(F.broadcast(m)).withColumns({c: F.coalesce(finite(c), F.col(f"__{c}")) for c in columns}).drop(*m.columns)


def regression_frame(df: DataFrame, target: str, features: list[str], dummies: dict[str, list[str]] | None = None, standardise: bool = True, const: bool = True) -> DataFrame:
    """Complete rows with standardised features, 0/1 columns for all but the first value of each dummy, and a constant."""
    keep = df.select(target, *features, *(dummies or {})).na.drop()
    out = z_scores(keep, features, "") if standardise else keep
    out = out.withColumns({f"{c}_{v}": (F.col(c) == v).cast("double") for c, vs in (dummies or {}).items() for v in sorted(vs)[1:]}).drop(*(dummies or {}))
    return out.withColumn("const", F.lit(1.0)) if const else out


def variance_inflation(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, vif): the diagonal of the inverse of the correlation matrix of complete rows."""
    import numpy as np
    import pandas as pd

    full = df.select(*[finite(f).alias(f) for f in features]).na.drop()
    pairs = [F.coalesce(corr_guarded(a, b), F.lit(0.0)).alias(f"r{i}_{j}") for i, a in enumerate(features) for j, b in enumerate(features) if i < j] or [F.lit(0.0).alias("none")]

    def solve(batches):
        for pdf in batches:
            for r in pdf.to_dict("records"):
                m = np.eye(len(features))
                for i in range(len(features)):
                    for j in range(i + 1, len(features)):
                        m[i, j] = m[j, i] = r[f"r{i}_{j}"]
                d = np.diag(np.linalg.inv(m)) if np.linalg.matrix_rank(m) == len(features) else np.full(len(features), np.inf)
                yield pd.DataFrame({"feature": features, "vif": d})

    return full.agg(*pairs).mapInPandas(solve, "feature string, vif double")


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the curve by the rank formula."""
    r = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).withColumn("__r", average_rank(score, []))
    pos, neg = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    return r.agg(F.try_divide(F.sum(F.when(F.col(label) == 1, F.col("__r"))) - pos * (pos + 1) / 2.0, pos * neg).alias("auc"))
