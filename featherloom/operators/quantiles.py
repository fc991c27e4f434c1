"""Exact quantiles (linear interpolation) of many columns and groups at once.

One pass builds a mergeable sketch per group and column, which brackets every wanted rank between two values of the table: at most
some six in ten thousand of a group's values lie strictly between them. A second pass counts what is below a bracket
and at its ends and keeps what is inside, for all of them together. The answer is read off, not estimated; a sketch
that missed is noticed by the counts, and the passes are repeated with wider brackets. Where the inside of a bracket may be too much for
one task, its values are counted and ranked chunk by chunk instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featherloom.operators.ordered import cumulative_counts, lookup_join, q
from featherloom.params import ParameterError
from featherloom.session import GROUP_ROWS, limit_of, materialise

_ACCURACY = 10_000
_SORTED_ROWS = 50_000  # values inside a bracket that one task may sort
_AT_ONCE = 50  # quantiles per aggregate


def _number(column: str) -> Column:
    return q(column).cast("double")


def _around(p: float, width: float) -> list[float]:
    return [max(0.0, p - width), min(1.0, p + width)]


def _inside_limit(df: DataFrame) -> int:
    return min(limit_of(df.sparkSession, GROUP_ROWS), _SORTED_ROWS)


def _at_rank(x: Column, lo: Column, hi: Column, rank: Column) -> Column:
    """Aggregate: the value at a rank (from 0) if it lies in [lo, hi], otherwise null."""
    below, at_lo, at_hi = F.count_if(x < lo), F.count_if(x == lo), F.count_if((x == hi) & (hi > lo))
    inside = F.sort_array(F.collect_list(F.when((x > lo) & (x < hi), x)))
    k = (rank - below - at_lo).cast("int")
    return F.when(rank < below, None).when(rank < below + at_lo, F.max(lo)).when(k < F.size(inside), F.get(inside, k)).when(k - F.size(inside) < at_hi, F.max(hi))


def _between(low: Column, high: Column, h: Column) -> Column:
    return low + (high - low) * (h - F.floor(h))


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> dict[str, list[float | None]]:
    """Quantiles of whole columns, returned as driver numbers (columns x probs of them)."""
    found = _whole(df, {(c, float(p)) for c in columns for p in probs})
    return {c: [found[c, float(p)] for p in probs] for c in columns}


def _whole(df: DataFrame, wanted: set[tuple[str, float]], width: float = 2 / _ACCURACY) -> dict[tuple[str, float], float | None]:
    names = list(dict.fromkeys(c for c, _ in sorted(wanted)))
    probs = {c: sorted(p for k, p in wanted if k == c) for c in names}
    out: dict[tuple[str, float], float | None] = {}
    if not names:
        return out
    sketched = df.agg(*[x for c in names for x in (F.count(q(c)), F.percentile_approx(_number(c), [a for p in probs[c] for a in _around(p, width)], _ACCURACY))]).first()
    counts, cuts = dict(zip(names, sketched[::2])), dict(zip(names, sketched[1::2]))
    jobs = []
    for c in names:
        for i, p in enumerate(probs[c]):
            if counts[c]:
                jobs.append((c, p, cuts[c][2 * i], cuts[c][2 * i + 1], p * (counts[c] - 1)))
            else:
                out[c, p] = None
    large = [j for j in jobs if counts[j[0]] * 3 * width > _inside_limit(df) and j[2] < j[3]]
    small = [j for j in jobs if j not in large]
    for at in range(0, len(small), _AT_ONCE):
        some = small[at: at + _AT_ONCE]
        exprs = [_at_rank(_number(c), F.lit(lo), F.lit(hi), F.lit(r)) for c, _, lo, hi, h in some for r in (int(h), -int(-h // 1))]
        row = df.agg(*exprs).first()
        out |= {(c, p): _mixed(row[2 * n], row[2 * n + 1], h) for n, (c, p, _, _, h) in enumerate(some)}
    if large:
        items = F.array(*[F.struct(F.lit(n).alias("__i"), _number(c).alias("__value"), F.lit(lo).alias("__lo"), F.lit(hi).alias("__hi"), F.lit(h).alias("__h")) for n, (c, _, lo, hi, h) in enumerate(large)])
        for r in _ranked(df.select(items.alias("__s")), []).collect():  # one row per quantile
            c, p = large[r["__i"]][:2]
            out[c, p] = r["__found"]
    missed = {k for k, v in out.items() if v is None and counts[k[0]]}
    return out | (_whole(df, missed, min(1.0, width * 8)) if missed else {})


def _mixed(low: float | None, high: float | None, h: float) -> float | None:
    return None if low is None or high is None else low + (high - low) * (h - int(h))


def _ranked(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(*keys, __i, __found) for rows with ``__s``: structs (__i, __value, __lo, __hi, __h); values in [__lo, __hi] are counted and ranked whatever their number."""
    each = rows.select(*[q(k) for k in keys], F.explode("__s").alias("__e")).where("__e.__value IS NOT NULL AND __e.__lo IS NOT NULL")
    renamed = {k: f"__k{n}" for n, k in enumerate(keys)}  # a key may be called "value" or "n"
    each = each.select(*[q(k).alias(new) for k, new in renamed.items()], "__e.*")
    group = [*renamed.values(), "__i"]
    below = each.groupBy(*group).agg(F.count_if(F.col("__value") < F.col("__lo")).alias("below"), F.max("__h").alias("h"))
    counts = each.where("__value >= __lo AND __value <= __hi").groupBy(*group, F.col("__value").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    ranked = lookup_join(cumulative_counts(counts, group, ["n"]), below, group, "inner")
    first, upto = F.col("below") + F.col("before_n"), F.col("below") + F.col("before_n") + F.col("n")

    def at(rank: Column) -> Column:
        return F.max(F.when((first <= rank) & (rank < upto), F.col("value")))

    found = ranked.groupBy(*group).agg(at(F.floor("h")).alias("a"), at(F.ceil("h")).alias("b"), F.max("h").alias("h"))
    return found.select(*[F.col(new).alias(k) for k, new in renamed.items()], "__i", _between(F.col("a"), F.col("b"), F.col("h")).alias("__found"))


def group_quantiles(df: DataFrame, keys: Sequence[str], wanted: dict[str, tuple[str, float]], width: float = 2 / _ACCURACY) -> DataFrame:
    """One row per group with quantiles of any number of columns: ``wanted`` is name -> (column, probability)."""
    keys = list(keys)
    if not keys:
        raise ParameterError("group columns are needed; use exact_quantiles for whole columns")
    group = [q(k) for k in keys]
    items = list(wanted.values())
    sketches = [x for n, (c, p) in enumerate(items) for x in (F.count(q(c)).alias(f"__n{n}"), F.percentile_approx(_number(c), _around(float(p), width), _ACCURACY).alias(f"__b{n}"))]
    brackets = materialise(df.groupBy(*group).agg(*sketches), "brackets")
    largest = max((v or 0 for v in brackets.agg(*[F.max(f"__n{n}") for n in range(len(items))]).first()), default=0)
    rows = lookup_join(df.select(*group, *dict.fromkeys(f"`{c}`" for c, _ in items if c not in keys)), brackets, keys)
    lo, hi = ([F.col(f"__b{n}")[k] for n in range(len(items))] for k in (0, 1))
    h = [F.lit(float(p)) * (F.col(f"__n{n}") - 1) for n, (_, p) in enumerate(items)]
    if largest * 3 * width <= _inside_limit(df):
        parts = []
        for n, (c, _) in enumerate(items):
            x, rank = _number(c), F.max(h[n])
            a, b = (_at_rank(x, lo[n], hi[n], r) for r in (F.floor(rank), F.ceil(rank)))
            parts.append(_between(a, b, rank).alias(f"__q{n}"))
        found = rows.groupBy(*group).agg(*parts)
    else:
        structs = F.array(*[F.struct(F.lit(n).alias("__i"), _number(c).alias("__value"), lo[n].alias("__lo"), hi[n].alias("__hi"), h[n].alias("__h")) for n, (c, _) in enumerate(items)])
        ranked = _ranked(rows.select(*group, structs.alias("__s")), keys)
        found = ranked.groupBy(*group).agg(*[F.max(F.when(F.col("__i") == n, F.col("__found"))).alias(f"__q{n}") for n in range(len(items))])
    found = materialise(lookup_join(brackets.select(*group, *[f"__n{n}" for n in range(len(items))]), found, keys), "quantiles")
    missed = [n for n, any_ in enumerate(found.agg(*[F.bool_or((F.col(f"__n{n}") > 0) & F.col(f"__q{n}").isNull()) for n in range(len(items))]).first()) if any_]
    out = found.select(*group, *[F.col(f"__q{n}").alias(name) for n, name in enumerate(wanted)])
    if missed:
        names = [list(wanted)[n] for n in missed]
        again = group_quantiles(df, keys, {k: wanted[k] for k in names}, min(1.0, width * 8))
        out = lookup_join(out.drop(*names), again, keys).select(*group, *[q(k) for k in wanted])
    return out


def grouped_quantiles(df: DataFrame, keys: Sequence[str], column: str, names: dict[str, float]) -> DataFrame:
    """One row per group with the named quantiles of one column."""
    return group_quantiles(df, keys, {n: (column, p) for n, p in names.items()})
