"""Ordered computation over groups of any size.

A Spark window puts one whole group in one task. That is right for groups of a checked
size; a group holding a third of a very large table needs to be cut. Here a table with a
too-large group is sorted as a whole by (keys, order) over range partitions and cut into
*chunks* of at most the row limit, so that (group, chunk) is what a task sees. Running values
get the totals of the earlier chunks added; bounded frames get the few neighbouring rows they
look back (or ahead) at copied into the chunk. Both give exactly what the plain window gives.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featherloom.session import GROUP_ROWS, broadcast_if_small, limit_of, materialise, shuffle_partitions, small_copy

CHUNK = "__chunk"
POSITION = "__position"


def q(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def split_order(order: Sequence[str]) -> list[tuple[str, bool]]:
    """``["date", "-id"]`` -> [("date", ascending), ("id", descending)]."""
    return [(o[1:], False) if o.startswith("-") else (o, True) for o in order]


def order_columns(order: Sequence[str]) -> list[Column]:
    """Sort columns, nulls last in both directions."""
    return [q(n).asc_nulls_last() if up else q(n).desc_nulls_last() for n, up in split_order(order)]


def window(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*[q(k) for k in keys]).orderBy(*order_columns(order))


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the largest group; a map-side combined count of the key columns."""
    if not keys:
        return df.count()
    return df.groupBy(*[q(k) for k in keys]).count().agg(F.max("count")).first()[0] or 0


def group_bound(df: DataFrame, keys: Sequence[str], known_bound: int | None = None) -> int:
    """The caller's bound on the rows of a group, or the largest group; for steps that order the same groups repeatedly."""
    return largest_group(df, keys) if known_bound is None else known_bound


def rows_to_cut(df: DataFrame, keys: Sequence[str], known_bound: int | None = None) -> int:
    """0 when every group fits one task, otherwise the rows of the whole table."""
    limit = limit_of(df.sparkSession, GROUP_ROWS)
    if known_bound is not None and known_bound <= limit:
        return 0
    if not keys:
        rows = df.count()
        return rows if rows > limit else 0
    sizes = df.groupBy(*[q(k) for k in keys]).count().agg(F.max("count").alias("largest"), F.sum("count").alias("rows")).first()
    return sizes["rows"] if (sizes["largest"] or 0) > limit else 0


def groups_fit(df: DataFrame, keys: Sequence[str]) -> bool:
    return largest_group(df, keys) <= limit_of(df.sparkSession, GROUP_ROWS)


def reversed_columns(order: Sequence[str]) -> list[Column]:
    """Exactly the opposite of :func:`order_columns`."""
    return [q(n).desc_nulls_first() if up else q(n).asc_nulls_first() for n, up in split_order(order)]


def latest_by(column: Column, order: Sequence[str]) -> Column:
    """Aggregate: the value in the last row of the order. Combines map-side, so group size does not matter."""
    parts = split_order(order)
    if all(up for _, up in parts):
        return F.max_by(column, F.struct(*[x for n, _ in parts for x in (q(n).isNull().alias(f"z_{n}"), q(n).alias(n))]))
    if not any(up for _, up in parts):
        return F.min_by(column, F.struct(*[x for n, _ in parts for x in (q(n).isNotNull().alias(f"z_{n}"), q(n).alias(n))]))
    raise ValueError("mixed sort directions are not supported here")


def earliest_by(column: Column, order: Sequence[str]) -> Column:
    """Aggregate: the value in the first row of the order."""
    parts = split_order(order)
    if all(up for _, up in parts):
        return F.min_by(column, F.struct(*[x for n, _ in parts for x in (q(n).isNull().alias(f"z_{n}"), q(n).alias(n))]))
    if not any(up for _, up in parts):
        return F.max_by(column, F.struct(*[x for n, _ in parts for x in (q(n).isNotNull().alias(f"z_{n}"), q(n).alias(n))]))
    raise ValueError("mixed sort directions are not supported here")


_EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def naive_micros(column: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone, independent of the session zone."""
    return F.timestamp_diff("MICROSECOND", F.expr(_EPOCH), column)


def from_naive_micros(micros: Column) -> Column:
    return F.timestamp_add("MICROSECOND", micros, F.expr(_EPOCH))


def literal_for(df: DataFrame, column: str, value) -> Column:
    """A driver value as a literal of the column's type; wall-clock times keep their digits in any session zone."""
    kind = df.schema[column].dataType
    if isinstance(value, datetime) and isinstance(kind, T.TimestampNTZType):
        value = value.isoformat(sep=" ")
    return F.lit(value).cast(kind)


def with_chunks(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int) -> DataFrame:
    """Add each row's position in the sort by (keys, order) and its chunk; ``rows`` is the size of the table.

    The sort is Spark's own over range partitions, so text counts in full, NaN and nulls stand where a
    window puts them and directions may differ. A chunk is a run of at most the row limit of one sorted
    partition, whatever the ties. Rows equal in the order are told apart by a hash of the row. The
    table is written, so that every later reader and every retry sees the same cuts.
    """
    limit = limit_of(df.sparkSession, GROUP_ROWS)
    parts = max(shuffle_partitions(df.sparkSession), -(-rows // limit))
    hashed = [f.name for f in df.schema.fields if not {"map", "variant"} & set(re.findall(r"\w+", f.dataType.simpleString()))]
    by = [*[q(k) for k in keys], *order_columns(order), F.col("__tie")]
    placed = (
        df.withColumn("__tie", F.xxhash64(*[q(c) for c in hashed]))
        .repartitionByRange(parts, *by)
        .sortWithinPartitions(*by)
        .drop("__tie")
        .withColumn(POSITION, F.monotonically_increasing_id())
    )
    return materialise(placed.withColumn(CHUNK, F.floor(F.col(POSITION) / limit)), "chunks")


def _null_safe(left: DataFrame, right: DataFrame, on: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in on:
        cond = cond & left[f"`{k}`"].eqNullSafe(right[f"`__r_{k}`"])
    return cond


def _attach(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Null-safe equi join that keeps the left key columns only."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in on})
    return left.join(renamed, _null_safe(left, renamed, on), how).drop(*[f"__r_{k}" for k in on])


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: dict[str, tuple[str, Column]],
    include_current: bool = True,
    known_bound: int | None = None,
) -> DataFrame:
    """Add running values per group: name -> (sum | count | max | min | last, column).

    ``last`` is the latest non-null value. The order must identify rows within a group.
    """
    upto = 0 if include_current else -1
    frame = (Window.unboundedPreceding, upto)
    agg: dict[str, Callable[[Column], Column]] = {
        "sum": F.sum, "count": F.count, "max": F.max, "min": F.min,
        "last": lambda c: F.last(c, ignorenulls=True),
    }
    rows = rows_to_cut(df, keys, known_bound)
    if not rows:
        w = window(keys, order).rowsBetween(*frame)
        return df.withColumns({n: agg[k](c).over(w) for n, (k, c) in columns.items()})

    chunked = with_chunks(df, keys, order, rows)
    group = [*keys, CHUNK]
    w = window(group, [POSITION]).rowsBetween(*frame)
    local = chunked.withColumns({f"__l_{n}": agg[k](c).over(w) for n, (k, c) in columns.items()})

    def total(kind: str, c: Column) -> Column:
        if kind != "last":
            return agg[kind](c)
        return F.max_by(c, F.when(c.isNotNull(), F.col(POSITION)))  # a null position is ignored

    totals = chunked.groupBy(*[q(g) for g in group]).agg(
        *[total(k, c).alias(f"__t_{n}") for n, (k, c) in columns.items()]
    )
    # one row per (group, chunk): at most as many rows per group as there are chunks
    earlier = Window.partitionBy(*[q(k) for k in keys]).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    over = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min, "last": lambda c: F.last(c, ignorenulls=True)}
    carry = totals.select(
        *[q(g) for g in group], *[over[k](F.col(f"__t_{n}")).over(earlier).alias(f"__c_{n}") for n, (k, _) in columns.items()]
    )
    joined = _attach(local, carry, group)

    def combine(name: str, kind: str) -> Column:
        here, before = F.col(f"__l_{name}"), F.col(f"__c_{name}")
        if kind == "count":
            return here + F.coalesce(before, F.lit(0))
        if kind == "sum":
            return F.coalesce(here + before, here, before)
        if kind == "max":
            return F.greatest(here, before)
        if kind == "min":
            return F.least(here, before)
        return F.coalesce(here, before)

    result = joined.withColumns({n: combine(n, k) for n, (k, _) in columns.items()})
    return result.drop(CHUNK, POSITION, *[f"__l_{n}" for n in columns], *[f"__c_{n}" for n in columns])


def framed(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    build: Callable,
    back: int = 0,
    ahead: int = 0,
    known_bound: int | None = None,
) -> DataFrame:
    """Add columns whose frames reach at most ``back`` rows before and ``ahead`` rows after.

    ``build(window)`` gets the partitioned and ordered window and returns {name: Column}.
    """
    rows = rows_to_cut(df, keys, known_bound)
    if not rows:
        return df.withColumns(build(window(keys, order)))

    chunked = with_chunks(df, keys, order, rows)
    group = [*keys, CHUNK]
    pieces = [chunked.withColumn("__halo", F.lit(False))]
    pieces += [_halo(chunked, keys, reach, backwards) for reach, backwards in ((back, True), (ahead, False)) if reach]
    together = reduce(DataFrame.unionByName, pieces)
    return together.withColumns(build(window(group, [POSITION]))).where(~F.col("__halo")).drop(CHUNK, POSITION, "__halo")


def _halo(chunked: DataFrame, keys: Sequence[str], reach: int, backwards: bool) -> DataFrame:
    """The rows other chunks of the group look at, marked with the chunk that looks: at most ``reach`` rows per chunk.

    Chunks are first compared by where they start and end in the group, one small row each; only the
    outer ``reach`` rows of a chunk then travel, each to the chunks it is within reach of.
    """
    group = [*keys, CHUNK]
    by_key = Window.partitionBy(*[q(k) for k in keys])
    spans = chunked.groupBy(*[q(g) for g in group]).agg(F.count(F.lit(1)).alias("__n"))
    spans = spans.withColumn("__end", F.sum("__n").over(by_key.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, 0)))
    spans = spans.withColumn("__start", F.col("__end") - F.col("__n"))
    span = limit_of(chunked.sparkSession, GROUP_ROWS) + reach
    if backwards:
        lookers, edge, mine = by_key.orderBy("__start").rangeBetween(1, span), "__start", F.col("__end")
    else:
        lookers, edge, mine = by_key.orderBy("__end").rangeBetween(-span, -1), "__end", F.col("__start")
    found = F.collect_list(F.struct(F.col(CHUNK).alias("chunk"), F.col(edge).alias("edge"))).over(lookers)
    between = F.transform(found, lambda t: F.struct(t["chunk"].alias("chunk"), F.abs(t["edge"] - mine).alias("gap")))
    near = spans.select(*[q(g) for g in group], between.alias("__near"))
    outward = Window.partitionBy(*[q(g) for g in group]).orderBy(F.desc(POSITION) if backwards else F.asc(POSITION))
    outer = chunked.withColumn("__rn", F.row_number().over(outward)).where(F.col("__rn") <= reach)
    target = F.explode(F.filter("__near", lambda t: t["gap"] + F.col("__rn") <= reach))
    sent = _attach(outer, near, group, "inner").withColumn("__to", target)
    return sent.withColumn(CHUNK, F.col("__to.chunk")).withColumn("__halo", F.lit(True)).drop("__rn", "__near", "__to")


def row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, known_bound: int | None = None) -> DataFrame:
    """1, 2, 3 ... per group, or over the whole table when there are no keys."""
    return running(df, keys, order, {name: ("count", F.lit(1))}, known_bound=known_bound)


def value_counts(df: DataFrame, column: str, keys: Sequence[str] = (), weights: dict[str, Column] | None = None) -> DataFrame:
    """Distinct non-null values with their row count (or the given sums)."""
    aggs = weights or {"n": F.lit(1)}
    return (
        df.where(q(column).isNotNull())
        .groupBy(*[q(k) for k in keys], q(column).alias("value"))
        .agg(*[F.sum(c).alias(n) for n, c in aggs.items()])
    )


def cumulative_counts(counts: DataFrame, keys: Sequence[str], sums: Sequence[str], descending: bool = False) -> DataFrame:
    """Add ``before_<s>`` (strictly earlier values) to a table of distinct values."""
    order = ["-value" if descending else "value"]
    out = running(counts, keys, order, {f"before_{s}": ("sum", q(s)) for s in sums}, include_current=False)
    return out.withColumns({f"before_{s}": F.coalesce(F.col(f"before_{s}"), F.lit(0)) for s in sums})


def average_ranks(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """One row per distinct value: value, n, rank (ties share the mean rank)."""
    ranked = cumulative_counts(value_counts(df, column, keys), keys, ["n"])
    return ranked.withColumn("rank", F.col("before_n") + (F.col("n") + 1) / 2).drop("before_n")


def lookup_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Join a table with one row per key onto rows whose keys may be very uneven.

    Small lookups are broadcast after a size check. Larger ones are shuffled, with the hot
    keys of the left side spread over salts and their lookup rows repeated for each salt.
    """
    small = small_copy(right)
    if small is not None:
        return _attach(left, small, on, how)
    spark = left.sparkSession
    limit = limit_of(spark, GROUP_ROWS)
    hot = left.groupBy(*[q(k) for k in on]).count().where(F.col("count") > limit).drop("count").withColumn("__hot", F.lit(1))
    if not hot.limit(1).count():
        return _attach(left, right, on, how)
    hot = broadcast_if_small(hot)  # at most rows / limit keys
    salts = shuffle_partitions(spark)
    salted = _attach(left, hot, on)
    salted = salted.withColumn(
        "__salt", F.when(F.col("__hot").isNotNull(), F.pmod(F.xxhash64(*[q(c) for c in left.columns]), F.lit(salts))).otherwise(0).cast("int")
    ).drop("__hot")
    spread = _attach(right, hot, on)
    spread = spread.withColumn(
        "__salt", F.explode(F.when(F.col("__hot").isNotNull(), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))
    ).drop("__hot")
    return _attach(salted, spread, [*on, "__salt"], how).drop("__salt")
