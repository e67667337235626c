"""Hypothesis tests: one result row per series, from grouped moments or counted ranks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigtab.functions.numeric import div, finite, keys
from sigtab.functions.tails import chi2_sf, f_sf, f_tail, norm_cdf, norm_ppf, ranksum_p, signed_rank_p, t_ppf, t_sf
from sigtab.operators.distributions import ranked_values
from sigtab.plans.layout import join_by, lay_out, with_stats, with_table
from sigtab.plans.normeq import map_rows, number
from sigtab.plans.quantile import medians, mid_ranks



def _present(df: DataFrame, columns: list[str], policy: str) -> DataFrame:
    """Rows with all values. ``raise`` refuses missing values; ``propagate`` lets them void the result."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & finite(F.col(f"`{c}`")).isNotNull()
    if policy == "omit":
        return df.filter(ok)
    missing = not df.filter(~ok).isEmpty()
    if missing and policy == "raise":
        raise ValueError("the data hold missing or infinite values")
    if policy not in ("raise", "propagate"):
        raise ValueError(f"unknown policy: {policy}")
    return df


def _void_where_missing(table: DataFrame, df: DataFrame, by: list[str], columns: list[str], policy: str) -> DataFrame:
    if policy != "propagate":
        return table
    bad = F.lit(False)
    for c in columns:
        bad = bad | finite(F.col(f"`{c}`")).isNull()
    flags = df.groupBy(*by).agg(F.max(bad).alias("_bad"))
    out = with_table(table, flags, by)
    keep = set(by) | {f.name for f in table.schema.fields if f.dataType.typeName() in ("long", "string")}
    return out.select(*[F.col(c) if c in keep else F.when(~F.col("_bad"), F.col(c)).alias(c) for c in table.columns])


def _t_result(difference: Column, se: Column, dof: Column, alternative: str) -> tuple[Column, Column]:
    inf = F.lit(float("inf"))
    t = F.when(se > 0, difference / F.when(se > 0, se)).when(difference == 0, F.lit(0.0)).otherwise(F.signum(difference) * inf)
    if alternative == "two-sided":
        p = 2 * t_sf(F.abs(t), dof)
    elif alternative == "greater":
        p = t_sf(t, dof)
    elif alternative == "less":
        p = t_sf(-t, dof)
    else:
        raise ValueError(f"unknown alternative: {alternative}")
    p = F.when((se <= 0) & (difference == 0), F.lit(1.0)).otherwise(F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)))
    return t, p


def _interval(estimate: Column, se: Column, dof: Column, alternative: str, confidence: float):
    q = (1 + confidence) / 2 if alternative == "two-sided" else confidence
    margin = t_ppf(F.lit(q), dof) * se
    low = estimate - margin if alternative != "less" else F.lit(None).cast("double")
    high = estimate + margin if alternative != "greater" else F.lit(None).cast("double")
    return low, high


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / F.when(b > 0, b)).when(a == 0, F.lit(0.0)).otherwise(F.signum(a) * F.lit(float("inf")))


def _small_sample(dof: Column) -> Column:
    return F.when(dof > 1, 1 - F.lit(3.0) / (4 * dof - 1))


def _t_columns(table: DataFrame, by, difference, estimate, se, dof, sd, effect_dof, alternative, confidence, extra):
    """Statistic, p, interval and effect sizes; the numbers feed Arrow functions, so they are named first."""
    base = table.select(*by, *extra, estimate.alias("estimate"), difference.alias("_d"), se.alias("standard_error"),
                        dof.alias("df"), sd.alias("_sd"), effect_dof.alias("_ed"))
    t, p = _t_result(F.col("_d"), F.col("standard_error"), F.col("df"), alternative)
    low, high = _interval(F.col("estimate"), F.col("standard_error"), F.col("df"), alternative, confidence)
    d = _ratio(F.col("_d"), F.col("_sd"))
    return base.select(
        *by, *[c for c in base.columns if c not in by and not c.startswith("_")], t.alias("statistic"), p.alias("p_value"),
        low.alias("ci_low"), high.alias("ci_high"), d.alias("cohen_d"), (d * _small_sample(F.col("_ed"))).alias("hedges_g"))


def one_sample_t(df: DataFrame, value: str, mean: float = 0.0, by=None, alternative: str = "two-sided",
                 confidence: float = 0.95, nan_policy: str = "omit") -> DataFrame:
    by = keys(by)
    x = finite(value)
    m = _present(df, [value], nan_policy).groupBy(*by).agg(
        F.count(x).alias("n"), F.avg(x).alias("_m"), F.stddev_samp(x).alias("_s")).filter("n >= 2")
    out = _t_columns(m, by, F.col("_m") - F.lit(mean), F.col("_m"), F.col("_s") / F.sqrt("n"),
                     (F.col("n") - 1).cast("double"), F.col("_s"), (F.col("n") - 1).cast("double"), alternative, confidence, ["n"])
    return _void_where_missing(out, df, by, [value], nan_policy)


def independent_t(df: DataFrame, value: str, group: str, first, second, by=None, equal_var: bool = False,
                  alternative: str = "two-sided", confidence: float = 0.95, nan_policy: str = "omit") -> DataFrame:
    """Welch's test, or the pooled one, of the values of two groups."""
    by = keys(by)
    x, g = finite(value), F.col(group)
    a, b = F.when(g == first, x), F.when(g == second, x)
    rows = _present(df.filter(g.isin(first, second)), [value], nan_policy)
    m = rows.groupBy(*by).agg(
        F.count(a).alias("n_first"), F.count(b).alias("n_second"), F.avg(a).alias("_m1"), F.avg(b).alias("_m2"),
        F.var_samp(a).alias("_v1"), F.var_samp(b).alias("_v2")).filter("n_first >= 2 AND n_second >= 2")
    n1, n2 = F.col("n_first").cast("double"), F.col("n_second").cast("double")
    pooled = ((n1 - 1) * F.col("_v1") + (n2 - 1) * F.col("_v2")) / (n1 + n2 - 2)
    if equal_var:
        dof, se = n1 + n2 - 2, F.sqrt(pooled * (1 / n1 + 1 / n2))
    else:
        u, w = F.col("_v1") / n1, F.col("_v2") / n2
        below = u * u / (n1 - 1) + w * w / (n2 - 1)
        dof = F.when(below > 0, (u + w) * (u + w) / F.when(below > 0, below)).otherwise(n1 + n2 - 2)
        se = F.sqrt(u + w)
    diff = F.col("_m1") - F.col("_m2")
    out = _t_columns(m, by, diff, diff, se, dof, F.sqrt(pooled), n1 + n2 - 2, alternative, confidence, ["n_first", "n_second"])
    return _void_where_missing(out, df, by, [value], nan_policy)


def paired_t(df: DataFrame, first: str, second: str, by=None, alternative: str = "two-sided",
             confidence: float = 0.95, nan_policy: str = "omit") -> DataFrame:
    """One-sample test of the row-wise differences over complete pairs."""
    rows = _present(df, [first, second], nan_policy).withColumn("_diff", finite(first) - finite(second))
    out = one_sample_t(rows, "_diff", 0.0, by, alternative, confidence)
    return _void_where_missing(out, df, keys(by), [first, second], nan_policy)


def one_way_anova(df: DataFrame, value: str, group: str, by=None, nan_policy: str = "omit") -> DataFrame:
    """Between and within sums of squares, F, p, eta² and omega² from group moments."""
    by = keys(by)
    x = finite(value)
    rows = _present(df.filter(F.col(group).isNotNull()), [value], nan_policy)
    cells = rows.groupBy(*by, group).agg(F.count(x).alias("_n"), F.avg(x).alias("_m"), F.var_pop(x).alias("_v"))
    cells = with_stats(cells.filter("_n > 0"), by, {"_gm": F.sum(F.col("_n") * F.col("_m")) / F.sum("_n")})
    gap = F.col("_m") - F.col("_gm")
    m = cells.groupBy(*by).agg(
        F.sum("_n").alias("n"), F.count(F.lit(1)).alias("groups"), F.sum(F.col("_n") * gap * gap).alias("ss_between"),
        F.sum(F.col("_n") * F.col("_v")).alias("ss_within"))
    m = m.filter((F.col("groups") >= 2) & (F.col("n") > F.col("groups")))
    m = m.withColumn("df_between", (F.col("groups") - 1).cast("double")).withColumn(
        "df_within", (F.col("n") - F.col("groups")).cast("double"))
    msb, msw = F.col("ss_between") / F.col("df_between"), F.col("ss_within") / F.col("df_within")
    total = F.col("ss_between") + F.col("ss_within")
    m = m.withColumn("f_statistic", _ratio(msb, msw))
    out = m.select(
        *by, "n", "groups", "ss_between", "ss_within", "df_between", "df_within", "f_statistic",
        f_sf(F.col("f_statistic"), F.col("df_between"), F.col("df_within")).alias("p_value"),
        F.when(total > 0, F.col("ss_between") / F.when(total > 0, total)).otherwise(F.lit(0.0)).alias("eta_squared"),
        F.when(total + msw > 0, F.greatest(F.lit(0.0), (F.col("ss_between") - F.col("df_between") * msw)
                                           / F.when(total + msw > 0, total + msw))).otherwise(F.lit(0.0)).alias("omega_squared"))
    return _void_where_missing(out, df, by, [value], nan_policy)


def anova_cells(df: DataFrame, value: str, a: str, b: str, by=None) -> DataFrame:
    """Count, mean and within-cell sum of squares per level pair."""
    by = keys(by)
    x = finite(value)
    rows = df.filter(x.isNotNull() & F.col(a).isNotNull() & F.col(b).isNotNull())
    return rows.groupBy(*by, F.col(a).cast("string").alias("level_a"), F.col(b).cast("string").alias("level_b")).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), (F.var_pop(x) * F.count(x)).alias("ss"))


ANOVA_FIELDS = "term string, sum_squares double, df double, mean_square double, f_statistic double, p_value double, eta_squared double, partial_eta_squared double"


def _between_levels(n: np.ndarray, dev: np.ndarray, at: np.ndarray) -> float:
    """Sum of squares that the means of one factor explain; ``dev`` are cell means about the grand mean."""
    size, total = np.bincount(at, n), np.bincount(at, n * dev)
    return float((total * total / size).sum())


def _weighted_means(n: np.ndarray, dev: np.ndarray, at: np.ndarray, levels: int) -> float:
    """Type III sum of squares of a factor beside an interaction, all cells filled: its unweighted means, weighted by their precision."""
    each = np.bincount(at)
    mean = np.bincount(at, dev) / each
    weight = each * each / np.bincount(at, 1 / n)
    middle = (weight * mean).sum() / weight.sum()
    return float((weight * (mean - middle) ** 2).sum())


def _additive_residual(n: np.ndarray, dev: np.ndarray, ia: np.ndarray, ib: np.ndarray) -> float:
    """Between-cell sum of squares that two additive factors leave.

    The normal equations come from the cell sums; the factor with more levels is eliminated, so only a system of
    the smaller number of levels is solved.
    """
    if ia.max() < ib.max():
        ia, ib = ib, ia
    counts = np.zeros((ia.max() + 1, ib.max() + 1))
    np.add.at(counts, (ia, ib), n)
    size_a, sum_a, sum_b = counts.sum(1), np.bincount(ia, n * dev), np.bincount(ib, n * dev)
    schur = np.diag(counts.sum(0)) - counts.T @ (counts / size_a[:, None])
    effect, _, rank, _ = np.linalg.lstsq(schur, sum_b - counts.T @ (sum_a / size_a), rcond=1e-12)
    if rank < counts.shape[1] - 1:
        raise ValueError("the design is rank deficient")
    other = (sum_a - counts @ effect) / size_a
    left = dev - other[ia] - effect[ib]
    return float((n * left * left).sum())


def two_way_anova(df: DataFrame, value: str, a: str, b: str, by=None, interaction: bool = True,
                  ss_type: int = 2) -> DataFrame:
    """Type II or III table of two factors, solved on the level cells instead of the rows.

    At most 256 levels per factor. Empty cells with interaction, or no replication, are an error.
    """
    by = keys(by)
    cells = anova_cells(df, value, a, b, by)
    names = {"a": a, "b": b, "ab": f"{a}:{b}"}

    def table(pdf: pd.DataFrame) -> pd.DataFrame:
        n, mean = pdf["n"].to_numpy(float), pdf["mean"].to_numpy(float)
        la, ia = np.unique(pdf["level_a"], return_inverse=True)
        lb, ib = np.unique(pdf["level_b"], return_inverse=True)
        if min(len(la), len(lb)) < 2:
            raise ValueError("each factor needs two levels")
        if interaction and len(pdf) < len(la) * len(lb):
            raise ValueError("empty level cells: the design is rank deficient")
        grand = (n * mean).sum() / n.sum()
        dev = mean - grand
        within = pdf["ss"].sum()
        one_a, one_b = (_between_levels(n, dev, at) for at in (ia, ib))
        additive = _additive_residual(n, dev, ia, ib)
        between = float((n * dev * dev).sum())
        sse, dof = within + (0.0 if interaction else additive), n.sum() - (len(pdf) if interaction else len(la) + len(lb) - 1)
        if dof <= 0:
            raise ValueError("no replication: the residual variance cannot be estimated")
        total = within + between
        specs = []
        for term, at, levels, other in (("a", ia, len(la), one_b), ("b", ib, len(lb), one_a)):
            if interaction and ss_type != 2:
                ss = _weighted_means(n, dev, at, levels)
            else:
                ss = between - other - additive  # what the factor adds to the other one
            specs.append((names[term], max(0.0, float(ss)), float(levels - 1)))
        if interaction:
            specs.append((names["ab"], max(0.0, additive), float((len(la) - 1) * (len(lb) - 1))))
        mse, out = sse / dof, []
        for term, ss, d in specs:
            f = ss / d / mse if mse > 0 else (0.0 if ss == 0 else float("inf"))
            out.append((term, ss, d, ss / d, f, float(f_tail(f, d, dof)), ss / total if total > 0 else 0.0,
                        ss / (ss + sse) if ss + sse > 0 else 0.0))
        out.append(("Residual", sse, dof, mse, None, None, None, None))
        res = pd.DataFrame(out, columns=["term", "sum_squares", "df", "mean_square", "f_statistic", "p_value",
                                         "eta_squared", "partial_eta_squared"])
        for k in by[::-1]:
            res.insert(0, k, pdf[k].iloc[0])
        return res

    head = "".join(f"`{k}` {cells.schema[k].dataType.simpleString()}, " for k in by)
    # at most 256 x 256 cells per series, checked above
    return cells.groupBy(*by).applyInPandas(table, head + ANOVA_FIELDS)


def mann_whitney(df: DataFrame, value: str, group: str, first, second, by=None, alternative: str = "two-sided",
                 continuity: bool = True, method: str = "auto") -> DataFrame:
    """U of the first group, its p, rank-biserial correlation and both medians.

    Ranks come from the distinct values with their counts. ``method``: ``normal`` is the tie-corrected normal law, ``exact``
    counts the arrangements of ranks (meant for values without ties), ``auto`` is exact without ties while one group has
    at most eight values and the product of both sizes is at most 8,000.
    """
    by = keys(by)
    if method not in ("auto", "exact", "normal"):
        raise ValueError(f"unknown method: {method}")
    rows = df.select(*by, finite(value).alias("_x"), F.col(group).alias("_g")).filter(
        F.col("_x").isNotNull() & F.col("_g").isin(first, second))
    ranks = mid_ranks(rows, by, "_x", {"_na": F.count_if(F.col("_g") == first)})
    t = F.col("ties").cast("double")
    m = ranks.groupBy(*by).agg(
        F.sum("_na").alias("n_first"), (F.sum("ties") - F.sum("_na")).alias("n_second"),
        F.sum(F.col("rank") * F.col("_na")).alias("_r"), F.sum(t * t * t - t).alias("_tt"))
    m = m.filter("n_first > 0 AND n_second > 0")
    n1, n2 = F.col("n_first").cast("double"), F.col("n_second").cast("double")
    n = n1 + n2
    u = F.col("_r") - n1 * (n1 + 1) / 2
    var = n1 * n2 / 12 * (n + 1 - div(F.col("_tt"), n * (n - 1)))
    med = medians(rows.select(*by, F.when(F.col("_g") == first, F.col("_x")).alias("a"),
                              F.when(F.col("_g") == second, F.col("_x")).alias("b")), by,
                  {"first_median": "a", "second_median": "b"})
    m = m.withColumn("statistic", u).withColumn("_z", _rank_z(u, n1 * n2 / 2, var, alternative, 0.5 if continuity else 0.0))
    small = (F.col("_tt") == 0) & (F.least("n_first", "n_second") <= 8) & (F.col("n_first") * F.col("n_second") <= 8000)
    counted = F.when(_exact(method, small), n1).otherwise(F.lit(0.0))
    p = F.when(_exact(method, small), ranksum_p(F.col("statistic"), counted, n2, F.lit(alternative))).otherwise(_rank_p(F.col("_z"), alternative))
    out = m.select(*by, "n_first", "n_second", "statistic", p.alias("p_value"),
                   (2 * F.col("statistic") / (n1 * n2) - 1).alias("rank_biserial"))
    return with_table(out, med, by)


def _exact(method: str, small: Column) -> Column:
    return small if method == "auto" else F.lit(method == "exact")


def _rank_z(stat: Column, mean: Column, var: Column, alternative: str, shift: float) -> Column:
    d = stat - mean
    if alternative == "two-sided":
        d = F.abs(d) - shift
    elif alternative == "greater":
        d = d - shift
    else:
        d = d + shift
    return div(d, F.sqrt(var))


def _rank_p(z: Column, alternative: str) -> Column:
    if alternative == "two-sided":
        return F.least(F.lit(1.0), 2 * norm_cdf(-z))
    return norm_cdf(-z) if alternative == "greater" else norm_cdf(z)


def wilcoxon(df: DataFrame, first: str, second: str | None = None, by=None, alternative: str = "two-sided",
             zero_method: str = "wilcox", correction: bool = False, method: str = "auto") -> DataFrame:
    """Signed-rank test of differences, its p, matched rank-biserial correlation.

    ``method``: ``normal`` is the normal law with tie correction, ``exact`` counts the signs of ranks (meant for differences
    without ties and zeros), ``auto`` is exact for up to 50 differences without ties and zeros.
    """
    if method not in ("auto", "exact", "normal"):
        raise ValueError(f"unknown method: {method}")
    if zero_method not in ("wilcox", "pratt", "zsplit"):
        raise ValueError(f"unknown zero method: {zero_method}")
    by = keys(by)
    d = finite(first) - finite(second) if second else finite(first)
    rows = df.select(*by, d.alias("_d")).filter(F.col("_d").isNotNull())
    ranked = rows if zero_method != "wilcox" else rows.filter("_d <> 0")
    signs = {"_pos": F.count_if(F.col("_d") > 0), "_neg": F.count_if(F.col("_d") < 0)}
    ranks = mid_ranks(ranked, by, F.abs(F.col("_d")), signs)
    t = F.col("ties").cast("double")
    zero = F.col("v") == 0
    m = ranks.groupBy(*by).agg(
        F.sum(F.col("rank") * F.col("_pos")).alias("_rp"), F.sum(F.col("rank") * F.col("_neg")).alias("_rn"),
        F.sum("ties").cast("double").alias("_n"), F.sum(F.when(zero, t).otherwise(F.lit(0.0))).alias("_z0"),
        F.sum(F.when(zero, F.lit(0.0)).otherwise(t * t * t - t)).alias("_tt"),
        F.sum(F.when(zero, F.col("rank") * F.col("ties")).otherwise(F.lit(0.0))).alias("_rz"),
        F.sum(F.col("_pos") + F.col("_neg")).alias("nonzero_pairs"))
    n, z0 = F.col("_n"), F.col("_z0")
    plus, minus = F.col("_rp"), F.col("_rn")
    mean, var = n * (n + 1) / 4, n * (n + 1) * (2 * n + 1)
    if zero_method == "zsplit":
        plus, minus = plus + F.col("_rz") / 2, minus + F.col("_rz") / 2
        var = var - (z0 * z0 * z0 - z0) / 2
    if zero_method == "pratt":
        mean = mean - z0 * (z0 + 1) / 4
        var = var - z0 * (z0 + 1) * (2 * z0 + 1)
    var = (var - F.col("_tt") / 2) / 24
    stat = F.least(plus, minus) if alternative == "two-sided" else plus
    m = m.withColumn("statistic", stat).withColumn("_plus", plus)
    shift = 0.5 if correction else 0.0
    z = _rank_z(F.col("_plus"), mean, var, alternative, shift)
    # the effect size always ranks the nonzero differences alone
    share = m if zero_method == "wilcox" else None
    if share is None:
        alone = mid_ranks(rows.filter("_d <> 0"), by, F.abs(F.col("_d")), signs).groupBy(*by).agg(
            F.sum(F.col("rank") * F.col("_pos")).alias("_ep"), F.sum(F.col("rank") * F.col("_neg")).alias("_en"))
        m = with_table(m, alone, by)
    else:
        m = m.withColumns({"_ep": F.col("_rp"), "_en": F.col("_rn")})
    m = with_table(m, rows.groupBy(*by).agg(F.count_if(F.col("_d") == 0).alias("_zeros")), by)
    small = (F.col("_tt") == 0) & (F.col("_n") <= 50) & (F.col("_zeros") == 0)
    counted = F.when(_exact(method, small), n).otherwise(F.lit(0.0))
    p = F.when(_exact(method, small), signed_rank_p(F.col("_plus"), counted, F.lit(alternative))).otherwise(_rank_p(z, alternative))
    out = m.select(*by, "nonzero_pairs", "statistic", p.alias("p_value"),
                   div(F.col("_ep") - F.col("_en"), F.col("_ep") + F.col("_en")).alias("rank_biserial"))
    totals = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("pairs"))
    totals = with_table(totals, medians(rows, by, {"median_difference": "_d"}), by)
    out = with_table(totals, out, by)
    none = F.coalesce(F.col("nonzero_pairs"), F.lit(0)) == 0
    return out.select(
        *by, "pairs", F.coalesce("nonzero_pairs", F.lit(0)).alias("nonzero_pairs"),
        F.when(none, F.lit(0.0)).otherwise(F.col("statistic")).alias("statistic"),
        F.when(none, F.lit(1.0)).otherwise(F.col("p_value")).alias("p_value"),
        F.when(none, F.lit(0.0)).otherwise(F.col("rank_biserial")).alias("rank_biserial"), "median_difference")


def kruskal_wallis(df: DataFrame, value: str, group: str, by=None) -> DataFrame:
    """H with tie correction, chi-square p and epsilon²."""
    by = keys(by)
    rows = df.select(*by, finite(value).alias("v"), F.col(group).alias("_g")).filter(
        F.col("v").isNotNull() & F.col("_g").isNotNull())
    counts = rows.groupBy(*by, "_g", "v").agg(F.count(F.lit(1)).alias("_c"))
    ranks = mid_ranks(rows, by, "v", {})
    per_group = join_by(counts, ranks, by + ["v"]).groupBy(*by, "_g").agg(
        F.sum("_c").cast("double").alias("_n"), F.sum(F.col("rank") * F.col("_c")).alias("_r"))
    t = F.col("ties").cast("double")
    ties = ranks.groupBy(*by).agg(F.sum(t * t * t - t).alias("_tt"))
    m = per_group.groupBy(*by).agg(
        F.sum("_n").alias("_N"), F.count(F.lit(1)).alias("groups"), F.sum(F.col("_r") * F.col("_r") / F.col("_n")).alias("_q"))
    m = with_table(m, ties, by).filter("groups >= 2")
    n = F.col("_N")
    h = F.lit(12.0) / (n * (n + 1)) * F.col("_q") - 3 * (n + 1)
    scale = 1 - F.col("_tt") / (n * n * n - n)
    m = m.withColumn("statistic", F.when(scale > 0, h / F.when(scale > 0, scale)).otherwise(F.lit(0.0)))
    k = F.col("groups").cast("double")
    return m.select(
        *by, n.cast("bigint").alias("n"), "groups", "statistic", (k - 1).alias("df"),
        F.when(scale > 0, chi2_sf(F.col("statistic"), k - 1)).otherwise(F.lit(1.0)).alias("p_value"),
        F.when(n > k, F.greatest(F.lit(0.0), (F.col("statistic") - k + 1) / F.when(n > k, n - k))).alias("epsilon_squared"))


def levene(df: DataFrame, value: str, group: str, by=None, center: str = "median", cut: float = 0.05) -> DataFrame:
    """Equality of variances: one-way ANOVA of the distances to each group's mean, median or trimmed mean."""
    by = keys(by)
    cell = by + ["_g"]
    rows = df.select(*by, F.col(group).alias("_g"), finite(value).alias("_x")).filter(
        F.col("_x").isNotNull() & F.col("_g").isNotNull())
    if center == "trimmed":
        sized = with_stats(rows.withColumn("_h", F.xxhash64("_x", "_g")), cell, {"_n": F.count(F.lit(1))})
        lay = lay_out(sized, cell, ["_x", "_h"])
        ranked = lay.done(lay.scan({"_i": ("index",)}))
        drop = F.floor(F.col("_n") * F.lit(cut))
        rows = ranked.filter((F.col("_i") >= drop) & (F.col("_i") < F.col("_n") - drop)).drop("_n", "_i", "_h")
    if center == "median":
        rows = with_table(rows, medians(rows, cell, {"_c": "_x"}), cell)
    elif center in ("mean", "trimmed"):
        rows = with_stats(rows, cell, {"_c": F.avg("_x")})
    else:
        raise ValueError(f"unknown centre: {center}")
    out = one_way_anova(rows.withColumn("_dist", F.abs(F.col("_x") - F.col("_c"))), "_dist", "_g", by)
    flat = F.col("ss_between") + F.col("ss_within") == 0
    return out.select(
        *by, "n", "groups", "df_between", "df_within",
        F.when(flat, F.lit(0.0)).otherwise(F.col("f_statistic")).alias("statistic"),
        F.when(flat, F.lit(1.0)).otherwise(F.col("p_value")).alias("p_value"))


def shapiro_wilk(df: DataFrame, value: str, by=None) -> DataFrame:
    """W and Royston's p for at least three values; the p-value is approximate above 5,000.

    Equal values share a run of ranks. The normal scores of all ranks are summed per value, with
    long runs cut into blocks that are spread over tasks.
    """
    by = keys(by)
    ranked = with_table(ranked_values(df, value, by).filter("n >= 3"), df.groupBy(*by).agg(F.avg(finite(value)).alias("_mean")), by)
    scored = ranked.withColumn("_m", norm_ppf((F.col("i") - 0.375) / (F.col("n") + 0.25)))
    d = F.col("value") - F.col("_mean")
    edge = lambda i: F.max(F.when(F.col("i") == i, d))
    m = scored.groupBy(*by).agg(
        F.first("n").cast("double").alias("n"), F.sum(F.col("_m") * F.col("_m")).alias("mm"),
        F.sum(F.col("_m") * d).alias("mx"), F.sum(d * d).alias("ss"),
        edge(F.lit(1)).alias("x1"), edge(F.lit(2)).alias("x2"), edge(F.col("n")).alias("xn"),
        edge(F.col("n") - 1).alias("xn1"), F.max("_m").alias("m1"),
        F.max(F.when(F.col("i") == F.col("n") - 1, F.col("_m"))).alias("m2"))

    def solve(r):
        n, mm = r["n"], r["mm"]
        if r["ss"] <= 0:
            return 1.0, 1.0
        if n == 3:
            a = math.sqrt(0.5)
            w = (a * (r["xn"] - r["x1"])) ** 2 / r["ss"]
            w = min(1.0, max(w, 0.75))
            return w, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
        u, root = 1 / math.sqrt(n), math.sqrt(mm)
        m1, m2 = r["m1"], r["m2"]
        # fixed values: Royston's polynomials for the end weights
        a1 = m1 / root + np.polyval([-2.706056, 4.434685, -2.07119, -0.147981, 0.221157, 0], u)
        if n > 5:
            a2 = m2 / root + np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0], u)
            phi = (mm - 2 * m1 ** 2 - 2 * m2 ** 2) / (1 - 2 * a1 ** 2 - 2 * a2 ** 2)
            inner = r["mx"] - m1 * (r["xn"] - r["x1"]) - m2 * (r["xn1"] - r["x2"])
            b = a1 * (r["xn"] - r["x1"]) + a2 * (r["xn1"] - r["x2"]) + inner / math.sqrt(phi)
        else:
            phi = (mm - 2 * m1 ** 2) / (1 - 2 * a1 ** 2)
            b = a1 * (r["xn"] - r["x1"]) + (r["mx"] - m1 * (r["xn"] - r["x1"])) / math.sqrt(phi)
        w = min(1.0, b * b / r["ss"])
        y, ln = math.log(max(1 - w, 1e-300)), math.log(n)
        # fixed values: Royston's normalising transforms of W
        if n <= 11:
            gamma = np.polyval([0.459, -2.273], n)
            if y >= gamma:
                return w, 1e-99
            y = -math.log(gamma - y)
            mu = np.polyval([-0.0006714, 0.025054, -0.39978, 0.544], n)
            sd = math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
        else:
            mu = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], ln)
            sd = math.exp(np.polyval([0.0030302, -0.082676, -0.4803], ln))
        return w, 0.5 * math.erfc((y - mu) / sd / math.sqrt(2))

    return map_rows(m, by, solve, [number("statistic"), number("p_value")], keep=["n"])


def adjust_p_values(df: DataFrame, p: str, order, by=None, method: str = "holm", alpha: float = 0.05) -> DataFrame:
    """Adjusted p-values within each family: none, bonferroni, sidak, holm, fdr_bh or fdr_by.

    Missing p-values stay null and do not count in the family size.
    """
    by, order = keys(by), keys(order)
    x = finite(p)
    rows = with_stats(df, by, {"_k": F.count(x)}).withColumn("_p", x)
    n = F.col("_k").cast("double")
    if method in ("none", "bonferroni", "sidak"):
        adj = {"none": F.col("_p"), "bonferroni": F.col("_p") * n,
               "sidak": -F.expm1(n * F.log1p(-F.when(F.col("_p") < 1, F.col("_p"))))}[method]
        if method == "sidak":
            adj = F.when(F.col("_p") >= 1, F.lit(1.0)).otherwise(adj)
        out = rows.withColumn("_adj", adj)
    elif method in ("holm", "fdr_bh", "fdr_by"):
        lay = lay_out(rows.filter("_p IS NOT NULL"), by, ["_p"] + order)
        ranked = lay.done(lay.scan({"_i": ("index",)}))
        rank = F.col("_i") + 1
        if method == "holm":
            ranked, kind = ranked.withColumn("_s", (n - F.col("_i")) * F.col("_p")), "max"
        else:
            # the harmonic number by its expansion, exact to double precision from 32 terms on
            small = F.aggregate(F.sequence(F.lit(1), F.least(F.col("_k"), F.lit(32))), F.lit(0.0), lambda s, k: s + F.lit(1.0) / k)
            n2 = n * n
            large = F.log(n) + F.lit(0.5772156649015329) + 1 / (2 * n) - 1 / (12 * n2) + 1 / (120 * n2 * n2) - 1 / (252 * n2 * n2 * n2)
            harmonic = F.when(F.col("_k") <= 32, small).otherwise(large) if method == "fdr_by" else F.lit(1.0)
            ranked, kind = ranked.withColumn("_s", F.col("_p") * n * harmonic / rank), "rmin"
        lay = lay_out(ranked, by, ["_p"] + order)
        done = lay.done(lay.scan({"_adj": (kind, "_s")})).drop("_i", "_s")
        rest = rows.filter("_p IS NULL").withColumn("_adj", F.lit(None).cast("double"))
        out = done.unionByName(rest)
    else:
        raise ValueError(f"unknown adjustment: {method}")
    adj = F.least(F.greatest(F.col("_adj"), F.lit(0.0)), F.lit(1.0))
    adj = F.when(F.col("_p").isNotNull(), adj)
    return out.withColumn("p_adjusted", adj).withColumn(
        "reject_null", F.coalesce(F.col("p_adjusted") <= alpha, F.lit(False))).drop("_p", "_k", "_adj")


# Lower limits of "small", "medium" and "large".
EFFECT_LIMITS = {"standardized": (0.2, 0.5, 0.8), "correlation": (0.1, 0.3, 0.5), "variance": (0.01, 0.06, 0.14)}


def effect_label(value: Column, kind: str) -> Column:
    """Verbal size of a standardized difference, a correlation or a share of variance."""
    small, medium, large = EFFECT_LIMITS[kind]
    size = F.greatest(value, F.lit(0.0)) if kind == "variance" else F.abs(value)
    return F.when(finite(value).isNull(), F.lit(None)).when(size < small, "negligible").when(
        size < medium, "small").when(size < large, "medium").otherwise("large")


def assumption_rows(df: DataFrame, value: str, group: str, by=None, alpha: float = 0.05) -> DataFrame:
    """Normality of each group and equality of variances, as rows ``assumption, statistic, p_value, holds``."""
    by = keys(by)
    normal = shapiro_wilk(df.filter(F.col(group).isNotNull()), value, by + [group]).select(
        *by, F.concat(F.lit("Shapiro-Wilk: "), F.col(group).cast("string")).alias("assumption"), "statistic", "p_value")
    equal = levene(df, value, group, by).select(*by, F.lit("Levene equal variance").alias("assumption"), "statistic", "p_value")
    return normal.unionByName(equal).withColumn("holds", F.col("p_value") > alpha)
