"""Aggregations and statistics (survey A1-A27, A39-A43, X1-X5).

All are one ``groupBy().agg()`` each, so Spark runs a partial (map-side)
aggregation before the shuffle: a key holding a third of the rows is
combined per task first and only one partial row per task crosses the
network. Quantiles are exact and come from ``quantiles.group_quantiles``,
which spreads a hot group over many tasks; a single quantile asked for with
``exact=False`` uses ``percentile_approx`` (a bounded sketch).

Results that feed a second step (share of total, scaled to max, histogram
edges) read a one-row aggregate as one scalar subquery (``DataFrame.scalar``)
holding a struct of all figures: Spark runs it once and inlines the value.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import rnd

from . import quantiles as Q
from . import rank


class Quantile:
    """A quantile inside an aggregation dict (``group_stats``, ``aggregate``);
    approximate only where ``exact=False`` is asked for in this very call.
    NULL and NaN values are missing."""

    def __init__(self, value, p: float, digits: int | None = None, exact: bool = True):
        self.value, self.p, self.digits, self.exact = value, float(p), digits, exact

    def with_digits(self, digits: int) -> "Quantile":
        return Quantile(self.value, self.p, digits, self.exact)


class DistinctCount:
    """``count(DISTINCT col)`` inside an aggregation dict. Computed in its own
    aggregation and joined on the keys, so it never shares an Expand with
    the other aggregates (an Expand multiplies the rows, and a percentile
    buffer per expanded group is very costly)."""

    def __init__(self, col: str):
        self.col = col


def distinct_count(col: str) -> DistinctCount:
    return DistinctCount(col)


def _join_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join of two per-key aggregates on NULL-safe key equality."""
    b2 = b.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in b.columns if c not in keys])
    cond = None
    for k in keys:
        c = a[k].eqNullSafe(b2[f"_k_{k}"])
        cond = c if cond is None else cond & c
    return a.join(b2, cond, "left").drop(*[f"_k_{k}" for k in keys])


def quantile(v: Column | str, p: float, exact: bool = True) -> Quantile:
    return Quantile(v, p, exact=exact)


def median(v: Column | str, exact: bool = True) -> Quantile:
    return Quantile(v, 0.5, exact=exact)


def mean_of_cents(value: Column | str, digits: int = 4) -> Column:
    """Mean of amounts with two decimals, rounded half up: summed as DECIMAL,
    so a mean that stands exactly on a tie doesn't depend on the order of the sum."""
    cents = (F.col(value) if isinstance(value, str) else value).cast("decimal(18,2)")
    return F.round(F.try_divide(F.sum(cents), F.count(cents)), digits).cast("double")


def _columns_of(df: DataFrame, exprs: Sequence[Column]) -> list[str]:
    """The columns of ``df`` that the aggregates read."""
    if not exprs:
        return []
    names, it = set(), df.agg(*exprs)._jdf.queryExecution().analyzed().references().iterator()
    while it.hasNext():
        names.add(it.next().name())
    return [c for c in df.columns if c in names]


def aggregate(df: DataFrame, keys: Sequence[str], aggs: Mapping[str, Column | Quantile], written: bool = False) -> DataFrame:
    """``groupBy(keys).agg(aggs)`` where some outputs may be quantiles or
    distinct counts. All exact quantiles of one value share one ranked table;
    the parts are put together on the keys (null-safe), or read as scalars
    where there are no keys. With exact quantiles ``df`` is read once: the
    columns that the aggregates need are written, and all parts read those
    (``written``: ``df`` is such a table already)."""
    keys = list(keys)
    dist = {n: e for n, e in aggs.items() if isinstance(e, DistinctCount)}
    plain = {n: e for n, e in aggs.items() if not isinstance(e, (Quantile, DistinctCount))}
    qs = {n: e for n, e in aggs.items() if isinstance(e, Quantile)}
    src, value_cols = df, {}
    for n, q in qs.items():
        if isinstance(q.value, str):
            value_cols[n] = q.value
        else:                                   # equal expressions are one value
            same = next((m for m in value_cols if not isinstance(qs[m].value, str) and str(qs[m].value) == str(q.value)), None)
            value_cols[n] = value_cols[same] if same else f"_qv_{n}"
            if same is None:
                src = src.withColumn(value_cols[n], q.value)
    for n, q in qs.items():
        if not q.exact:
            v = F.col(value_cols[n])
            plain[n] = F.percentile_approx(F.when(~F.isnan(v), v), F.lit(q.p), 10000)
    by_value: dict[str, dict[str, float]] = {}
    for n, q in qs.items():
        if q.exact:
            by_value.setdefault(value_cols[n], {})[n] = q.p
    if by_value and not written:
        from ..session import Scratch
        needed = dict.fromkeys([*keys, *value_cols.values(), *(d.col for d in dist.values()), *_columns_of(src, list(plain.values()))])
        src = Scratch(df.sparkSession, "aggregate").save(src.select(*needed))
    parts = [Q.group_quantiles(src, keys, vcol, probs) for vcol, probs in by_value.items()]
    # each distinct count by itself: first the distinct (keys, value), then their number
    for n, d in dist.items():
        parts.append(src.filter(F.col(d.col).isNotNull()).select(*keys, d.col).distinct()
                     .groupBy(*keys).agg(F.count(F.lit(1)).alias(n)))
    if keys:
        out = src.groupBy(*keys).agg(*[e.alias(n) for n, e in plain.items()]) if plain else src.select(*keys).distinct()
        for part in parts:
            out = _join_keys(out, part, keys)
    else:
        out = src.agg(*[e.alias(n) for n, e in plain.items()]) if plain else None
        if out is None:
            out = src.agg(F.count(F.lit(1)).alias("_rows"))
        for i, part in enumerate(parts):  # one subquery for each part
            out = out.withColumn(f"_part{i}", part.select(F.struct(*part.columns)).scalar())
            out = out.withColumns({c: F.col(f"_part{i}")[c] for c in part.columns})
    sel = [F.col(k) for k in keys]
    for n in aggs:
        e = F.coalesce(F.col(n), F.lit(0)) if n in dist else F.col(n)
        if n in qs and qs[n].digits is not None:
            e = rnd(e, qs[n].digits)
        sel.append(e.alias(n))
    return out.select(*sel)


def kpis(df: DataFrame, value: str, distinct: Mapping[str, str] | None = None,
         digits: int | None = None, exact: bool = True) -> DataFrame:
    """A1: rows, distinct counts, mean, median, min, max, sample std, sum."""
    v = F.col(value)
    aggs: dict = {"n_rows": F.count(F.lit(1))}
    for out, col in (distinct or {}).items():
        aggs[out] = distinct_count(col)
    stats = {"mean": F.avg(v), "median": median(v, exact), "min": F.min(v), "max": F.max(v),
             "std": F.stddev_samp(v), "total": F.sum(v)}
    for name, e in stats.items():
        aggs[name] = rnd(e, digits) if digits is not None else e
    return aggregate(df, [], aggs)


def percentiles(df: DataFrame, value: str, probs: Sequence[float], names: Sequence[str],
                exact: bool = True) -> DataFrame:
    """A2: several quantiles in one pass."""
    return aggregate(df, [], {n: quantile(value, p, exact) for p, n in zip(probs, names)})


def group_stats(df: DataFrame, keys: Sequence[str] | str, aggs: Mapping[str, Column],
                having: Column | None = None, order: Sequence[Column] | None = None,
                limit: int | None = None, drop_null_keys: bool = True, written: bool = False) -> DataFrame:
    """Group, aggregate,
    threshold, order (always made total by the keys), optional top-n.
    NULL keys are dropped, as pandas ``groupby`` does."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    src = df
    if drop_null_keys:
        for k in keys:
            src = src.filter(F.col(k).isNotNull())
    out = aggregate(src, keys, aggs, written)
    if having is not None:
        out = out.filter(having)
    if order is not None:
        total = list(order) + [F.col(k).asc() for k in keys]
        out = rank.top_n(out, total, limit) if limit else out.orderBy(*total)
    return out


def five_number(df: DataFrame, key: str, value: str, min_rows: int = 1,
                exact: bool = True, digits: int | None = None) -> DataFrame:
    """N (rows, NULL values included, as the study counts them),
    min, q1, median, q3, max, mean over non-NULL values; groups with fewer
    than ``min_rows`` rows dropped; ordered by median. The three quartiles
    share one percentile computation."""
    v = F.col(value)
    r = (lambda e: rnd(e, digits)) if digits is not None else (lambda e: e)
    return group_stats(df, key, {
        "n": F.count(F.lit(1)), "min": r(F.min(v)), "q1": r(quantile(value, 0.25, exact)),
        "median": r(median(value, exact)), "q3": r(quantile(value, 0.75, exact)),
        "max": r(F.max(v)), "mean": r(F.avg(v))},
        having=F.col("n") >= min_rows, order=[F.col("median").asc_nulls_last()])


def share(df: DataFrame, key: str, digits: int = 4) -> DataFrame:
    """Rows per key and share of all rows (NULL keys dropped)."""
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.select(key, "n", rnd(F.col("n") * 100.0 / total, digits).alias("pct"))


def dominant(df: DataFrame, key: str, out: str = "dominant") -> DataFrame:
    """Most frequent non-NULL value; ties -> smallest value. Counted with
    a distributed aggregation, then a top-1 (no global value map)."""
    return (df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.col("n").desc(), F.col(key).asc()).limit(1)
            .select(F.col(key).alias(out), "n"))


def best_key(df: DataFrame, key: str, value: str, out_key: str = "best",
             out_value: str = "best_mean") -> DataFrame:
    """Key with the highest mean (NULL keys and NULL means excluded;
    ties -> smallest key)."""
    means = (df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.avg(value).alias("_m"))
             .filter(F.col("_m").isNotNull()))
    return (means.orderBy(F.col("_m").desc(), F.col(key).asc()).limit(1)
            .select(F.col(key).alias(out_key), F.col("_m").alias(out_value)))


def ratio(df: DataFrame, value: str, cond_a: Column, cond_b: Column,
          percent: bool = False, out: str = "ratio") -> DataFrame:
    """Mean under cond_a over mean under cond_b (as a % premium when
    ``percent``); NULL when either side is empty."""
    a = F.avg(F.when(cond_a, F.col(value)))
    b = F.avg(F.when(cond_b, F.col(value)))
    r = F.try_divide(a - b, b) * 100 if percent else F.try_divide(a, b)
    return df.agg(a.alias("mean_a"), b.alias("mean_b"), r.alias(out))


def scaled_to_max(agg: DataFrame, cols: Sequence[str], suffix: str = "_scaled",
                  digits: int = 4) -> DataFrame:
    """Each column / its maximum over the table x 100. ``agg`` is
    already one row per key; the maxima are one row."""
    most = agg.agg(F.struct(*[F.max(c).alias(c) for c in cols])).scalar()
    out = agg.withColumn("_most", most)  # a column of its own: the subquery stands once in the plan
    return out.withColumns({c + suffix: rnd(F.try_divide(F.col(c), F.col("_most")[c]) * 100, digits) for c in cols}).drop("_most")


def histogram(df: DataFrame, value: str, bins: int = 30, cap: float | None = None,
              digits: int = 4) -> DataFrame:
    """Equal-width bins between min and max (numpy semantics: the last bin
    is closed on the right). Every bin is returned, empty ones with 0."""
    v = F.col(value)
    src = df.filter(v.isNotNull() & ~F.isnan(v))
    if cap is not None:
        src = src.filter(v <= cap)
    edges = src.agg(F.struct(F.min(v).alias("lo"), F.max(v).alias("hi")).alias("e"))
    src = src.withColumn("_e", edges.scalar())  # a column of its own: the subquery stands once
    e = F.col("_e")
    width = e["hi"] - e["lo"]
    idx = F.when(width == 0, F.lit(1)).otherwise(
        F.least(F.floor((v - e["lo"]) * bins / width) + 1, F.lit(bins)))
    counts = src.groupBy(idx.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    # one row per bin, empty ones too: all bins with 0, added to the counts (empty input -> no bins)
    grid = counts.limit(1).select(F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"), F.lit(0).cast("long").alias("n"))
    out = counts.unionByName(grid).groupBy("bin").agg(F.sum("n").alias("n")).withColumn("_e", edges.scalar())
    w = width / bins
    return out.select("bin", rnd(e["lo"] + (F.col("bin") - 1) * w, digits).alias("bin_lo"),
                      rnd(e["lo"] + F.col("bin") * w, digits).alias("bin_hi"), "n")


def histogram_lines(df: DataFrame, value: str, digits: int = 4) -> DataFrame:
    """The mean and median lines of the chart, over all values (the bars
    may be capped)."""
    return aggregate(df, [], {"mean": rnd(F.avg(value), digits), "median": rnd(median(value), digits)})


def corr_matrix(df: DataFrame, cols: Sequence[str], digits: int = 6) -> DataFrame:
    """Pairwise-complete Pearson r for every ordered pair, long form
    (var_a, var_b, r). Each unordered pair is one r = cov / (sx * sy) over
    the rows where both sides are present (NaN counts as missing, as in
    pandas), built from Spark's stable one-pass covariance / deviation
    aggregates, all pairs in ONE aggregation. A zero-variance side gives NULL
    (``try_divide``: no ANSI error); the diagonal is 1 where the variance is
    positive. Both orders of a pair come from the same aggregate row."""
    items = []
    for i in range(len(cols)):
        for j in range(i, len(cols)):
            x, y = F.col(cols[i]).cast("double"), F.col(cols[j]).cast("double")
            if i == j:
                xm = F.when(x.isNotNull() & ~F.isnan(x), x)
                r = F.when(F.stddev_samp(xm) > 0, F.lit(1.0))
            else:
                ok = x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y)
                xm, ym = F.when(ok, x), F.when(ok, y)
                r = F.try_divide(F.covar_samp(xm, ym), F.stddev_samp(xm) * F.stddev_samp(ym))
            items.append((cols[i], cols[j], r))
    one = df.agg(*[r.alias(f"_r{n}") for n, (_, _, r) in enumerate(items)])
    cells = []
    for n, (a, b, _) in enumerate(items):
        for p, q in {(a, b), (b, a)}:
            cells.append(F.struct(F.lit(p).alias("var_a"), F.lit(q).alias("var_b"), F.col(f"_r{n}").alias("r")))
    out = one.select(F.explode(F.array(*cells)).alias("_p")).select("_p.*")
    return out.select("var_a", "var_b", rnd(F.col("r"), digits).alias("r"))


def corr_flags(matrix: DataFrame, target: str, threshold: float = 0.3) -> DataFrame:
    """Variables whose |r| with ``target`` exceeds the threshold, with
    the direction of the relation."""
    return (matrix.filter((F.col("var_a") == target) & (F.col("var_b") != target)
                          & (F.abs(F.col("r")) > threshold))
            .select(F.col("var_b").alias("variable"), "r",
                    F.when(F.col("r") > 0, F.lit("positive")).otherwise(F.lit("negative")).alias("direction")))


def word_freq(df: DataFrame, text: str, value: str, tiebreak: str, top_share: float = 0.2,
              n: int = 15, min_len: int = 4) -> DataFrame:
    """Words of the titles in the top ``top_share`` rows by value
    (k = floor(share x rows)); the n most common words, then only words of at
    least ``min_len`` letters. Rows are counted per value; rows above the
    value at which the k-th row falls are in, and only its ties are ordered."""
    from ..session import Scratch
    v = F.col(value)
    df = Scratch(df.sparkSession, "word-freq").save(df.select(*dict.fromkeys([text, value, tiebreak])))  # read once
    per = df.groupBy(value).agg(F.count(F.lit(1)).alias("_w")).withColumn("_last", v.isNull())
    per = per.withColumn("_down", -v)
    k = F.floor(per.agg(F.sum("_w")).scalar() * top_share)
    run = rank_weights(per, ["_last", "_down"])
    cut = run.filter(F.col("_cum") <= k).agg(F.struct(F.max(F.struct("_last", "_down")).alias("at"), F.max("_cum").alias("taken"))).scalar()
    at = run.filter(F.col("_cum") > k).agg(F.min(F.struct("_last", "_down"))).scalar()
    place = F.struct(v.isNull().alias("_last"), (-v).alias("_down"))
    rows = df.select(text, tiebreak, place.alias("_at"))
    above = rows.filter(at.isNull() | (F.col("_at") < at)).select(text)
    ties = rows.filter(F.col("_at") == at).withColumn("_one", F.lit(1))
    ties = rank_weights(ties, [tiebreak], "_one").filter(F.col("_cum") <= k - F.coalesce(cut["taken"], F.lit(0))).select(text)
    words = (above.unionByName(ties)
             .select(F.explode(F.split(F.lower(F.trim(F.col(text))), r"\s+")).alias("word"))
             .filter(F.col("word") != ""))
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.col("n").desc(), F.col("word").asc()).limit(n)
    return top.filter(F.length("word") >= min_len)


def rank_weights(df: DataFrame, order: Sequence[str], weight: str = "_w") -> DataFrame:
    """Adds ``_cum``, the running sum of ``weight`` in ``order`` (total)."""
    return Q.weighted_prefix(df, order, weight)


def scatter_projection(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Numeric projection for a scatter matrix, every row."""
    return df.select(*cols)


def interpolated_percentile(value: Column | str, breakpoints: Column, levels: Sequence[float]) -> Column:
    """Position of ``value`` on a breakpoint table (``breakpoints[i]`` is
    the value at percentile ``levels[i]``, ascending): linear interpolation
    inside the bracket, clamped to the first/last level outside. The table
    is an array column (e.g. a scalar-subquery percentile array), so the
    "range join" is a CASE over its brackets -- no join at all."""
    v = F.col(value) if isinstance(value, str) else value
    bp = lambda i: F.element_at(breakpoints, i + 1)
    expr = F.when(v <= bp(0), F.lit(float(levels[0])))
    for i in range(len(levels) - 1):
        lo, hi = bp(i), bp(i + 1)
        frac = F.coalesce(F.try_divide(v - lo, hi - lo), F.lit(0.0))
        expr = expr.when(v <= hi, F.lit(float(levels[i])) + frac * (levels[i + 1] - levels[i]))
    return expr.otherwise(F.lit(float(levels[-1])))


def band_share(df: DataFrame, value: str, bands, out: str = "banda", digits: int = 4) -> DataFrame:
    """Rows per income band (lower edge inclusive) and share of all rows."""
    from ..functions.rules import bin_left_closed
    return share(df.filter(F.col(value).isNotNull()).withColumn(out, bin_left_closed(value, bands)), out, digits)
