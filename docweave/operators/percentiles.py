"""Exact percentiles of many groups by histogram refinement.

The ranks of interest are narrowed down, never sorted for: one map-side aggregate counts every
group's values in fixed bins of a monotone code (1.6 % of a value wide at most) with each bin's
least and greatest value. Running counts over these small tables tell which bins hold the
wanted ranks; the next pass reads only values inside those bins, in 4,096 finer ones (a mantissa
is exhausted after four such passes), until
a bin holds one value or few enough rows to be brought together and sorted. So a group with a third
of all rows costs partial aggregates of a few thousand rows a task, and a continuous column
never shuffles more than the values next to the wanted ranks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.session import staged

MANTISSA_BINS = 64  # bins to a factor of two
FINE_BINS = 4096
FEW_ROWS = 20_000  # the values of a bin of so many rows are brought together
LOCAL_BINS = 10_000  # so many wanted bins are kept on the driver and broadcast; more become a table
SKETCH_ACCURACY = 100_000  # rank error 1e-5


def with_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", also: Column | None = None) -> DataFrame:
    """``left`` joined with ``right``'s other columns by keys that may be null, and by the condition ``also``."""
    renamed = right.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    on = F.lit(True) if also is None else also
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return left.join(renamed, on, how).drop(*[f"_k{i}" for i in range(len(keys))])


def _code(v: str) -> str:
    """A bin number that never falls when the value rises: exponent, then a ``MANTISSA_BINS``-th of the mantissa. Zero,
    infinite values and NaN (greatest) have bins of their own. A rounded logarithm moves a value to the neighbouring bin's
    end at most, which keeps the order."""
    e = f"floor(log2(abs({v})))"
    size = f"({e} + 1100) * {MANTISSA_BINS} + floor((abs({v}) / pow(2D, {e}) - 1) * {MANTISSA_BINS})"
    return (f"case when isnan({v}) then 2000000L when {v} = 0 then 0L when abs({v}) = double('infinity') then cast(signum({v}) as bigint) * 1000000L "
            f"else cast(signum({v}) as bigint) * ({size}) end")


def _rank(p: float) -> str:
    return f"(_n - 1) * {p!r}D"


def _holds(rank: str) -> str:
    return f"(_at <= {rank} and {rank} < _at + _c)"


def _with_ranks(bins: DataFrame, shares: dict[str, float]) -> DataFrame:
    """Bins that hold a wanted rank; a group without values keeps its only row."""
    return bins.where(" or ".join(["_n = 0", *[_holds(f"{end}({_rank(p)})") for p in shares.values() for end in ("floor", "ceil")]]))


def _kept(bins: DataFrame) -> tuple[DataFrame, int | None]:
    """The bins evaluated once, and the rows of the fullest bin of several values (None: there is no such bin)."""
    head = bins.limit(LOCAL_BINS + 1).collect()
    if len(head) > LOCAL_BINS:
        bins = staged(bins, "percentile-bins")
        return bins, bins.selectExpr("max(case when _lo < _hi then _c end)").first()[0]
    several = [r["_c"] for r in head if r["_lo"] is not None and r["_lo"] < r["_hi"]]
    return F.broadcast(bins.sparkSession.createDataFrame(head, bins.schema)), max(several, default=None)


def group_percentiles(df: DataFrame, keys: list[str], col: str, shares: dict[str, float], sketch: bool = False,
                      sums: dict[str, Column] | None = None, few_rows: int = FEW_ROWS) -> DataFrame:
    """``keys``, a column for each of ``sums`` (summed over the group's rows) and one for each of ``shares``: that
    percentile of ``col``'s non-null values, exact, the two values next to rank p * (n - 1) interpolated.

    A group without values has null percentiles; null keys form a group. Only the values
    of bins of at most ``few_rows`` rows are ever brought together. ``sketch`` takes
    ``percentile_approx`` instead: one pass, a value of the data near the rank.
    """
    sums = sums or {}
    names = list(sums)
    if sketch:
        return df.groupBy(*keys).agg(*[F.sum(c).alias(n) for n, c in sums.items()], *[
            F.percentile_approx(F.col(col).cast("double"), F.lit(p), F.lit(SKETCH_ACCURACY)).cast("double").alias(n) for n, p in shares.items()])
    rows = df.select(*keys, F.col(col).cast("double").alias("_v"), *[c.alias(f"_s{i}") for i, c in enumerate(sums.values())])
    ids = [f"`{k}`" for k in keys]
    over = f"(partition by {', '.join(ids)} order by _b rows between unbounded preceding and 1 preceding)" if keys else \
        "(order by _b rows between unbounded preceding and 1 preceding)"
    group = f"(partition by {', '.join(ids)})" if keys else "()"
    extremes = [F.expr(e) for e in ("count(_v) as _c", "min(_v) as _lo", "max(_v) as _hi")]
    bins = rows.groupBy(*keys, F.expr(f"{_code('_v')} as _b")).agg(*extremes, *[F.expr(f"sum(_s{i}) as _t{i}") for i in range(len(sums))])
    bins = bins.selectExpr(*ids, "_c", "_lo", "_hi", f"coalesce(sum(_c) over {over}, 0L) as _at", f"sum(_c) over {group} as _n",
                           *[f"sum(_t{i}) over {group} as `{n}`" for i, n in enumerate(names)])
    bins, most = _kept(_with_ranks(bins, shares))
    values = rows.select(*keys, "_v").where("_v is not null")
    inside, several = F.expr("_v >= _lo and _v <= _hi"), "coalesce(_lo < _hi, false)"
    carried = [*keys, "_at", "_n", *names]
    over = over.replace("partition by ", "partition by _at, ") if keys else over.replace("(order", "(partition by _at order")
    while most is not None and most > few_rows:
        # the range may exceed a double: half of it does not
        half = "case when _hi - _lo < double('infinity') then 1D else 0.5D end"
        part = f"least(floor((_v * {half} - _lo * {half}) / (_hi * {half} - _lo * {half}) * {FINE_BINS}), {FINE_BINS - 1}L) as _b"
        finer = with_keys(values, bins.where(several).drop("_c"), keys, "inner", inside).groupBy(*carried, F.expr(part)).agg(*extremes)
        finer = finer.selectExpr(*ids, "_c", "_lo", "_hi", f"_at + coalesce(sum(_c) over {over}, 0L) as _at", "_n", *[f"`{n}`" for n in names])
        bins, most = _kept(_with_ranks(finer.unionByName(bins.where(f"not {several}")), shares))
    items = bins.where(f"not {several}").withColumnRenamed("_lo", "_v").select(*keys, "_n", *names, "_at", "_v")
    if most is not None:
        items = items.unionByName(with_keys(values, bins.where(several), keys, "inner", inside).select(*keys, "_n", *names, "_at", "_v"))
    # a group's items are the rows of the bins of its wanted ranks, ``few_rows`` of each at most: (first rank of the bin, value)
    found = items.groupBy(*keys, "_n", *names).agg(F.expr("array_sort(collect_list(case when _v is not null then struct(_at, _v) end)) as _items"))
    ranks = {f"{end}{i}": f"cast({end}({_rank(p)}) as bigint)" for i, p in enumerate(shares.values()) for end in ("floor", "ceil")}
    found = found.selectExpr("*", *[f"try_element_at(filter(_items, x -> x._at <= {r}), -1)._at as _a{k}" for k, r in ranks.items()])
    # a bin of one value is a single item, any other has an item for each of its ranks
    found = found.selectExpr(*ids, "_n", *[f"`{n}`" for n in names], *[
        f"transform(filter(_items, x -> x._at = _a{k}), x -> x._v) as _b{k}" for k in ranks], *[f"_a{k}" for k in ranks])
    found = found.selectExpr("*", *[f"get(_b{k}, cast(least({r} - _a{k}, size(_b{k}) - 1) as int)) as _v{k}" for k, r in ranks.items()])
    return found.selectExpr(*ids, *[f"`{n}`" for n in names], *[
        f"case when _vfloor{i} = _vceil{i} then _vfloor{i} else _vfloor{i} + (_vceil{i} - _vfloor{i}) * ({_rank(p)} - floor({_rank(p)})) end as `{n}`"
        for i, (n, p) in enumerate(shares.items())])
