"""Ordered computations that never put one whole group into one task.

A plain window over a subject, a model or a score group runs in a single task,
so one hot key stalls the job. Here every group is cut into *segments* along
its order. The running value inside a segment comes from a window over
(group, segment); what went before comes from one row per segment. Both levels
stay small whatever share of the rows a single key holds.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from eraloom.schemas import join_null_safe
from eraloom.session import materialize

INF = float("inf")


def segment_count(df: DataFrame) -> int:
    """Segments of an ordered pass: as many as shuffle partitions, which are set by the size of the data."""
    return max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def fit_splits(df: DataFrame, columns: Sequence[str], n: int | None = None) -> dict[str, list[float]]:
    """Equal-frequency cut points of the pooled columns, one small job for all.

    The result is at most ``n`` numbers per column. A segment of any single
    group is part of a pooled segment, so it holds at most about 1/n of the rows.
    """
    n = n or segment_count(df)
    doubles = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    probs = [i / n for i in range(1, n)]
    found = doubles.approxQuantile(list(columns), probs, 1.0 / (4 * n))
    return {c: sorted(set(v)) for c, v in zip(columns, found)}


def add_segment(df: DataFrame, column: str, splits: Sequence[float], out: str) -> DataFrame:
    """Number the equal-frequency interval of ``column`` (binary search in the JVM)."""
    if not splits:
        return df.withColumn(out, F.lit(0))
    value = f"__{out}_in"
    edges = [-INF, *[s for s in splits if abs(s) < INF], INF]
    bucketed = Bucketizer(
        splits=edges, inputCol=value, outputCol=out, handleInvalid="keep"
    ).transform(df.withColumn(value, F.col(column).cast("double")))
    return bucketed.drop(value).withColumn(out, F.col(out).cast("int"))


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    segment: str,
    sums: Sequence[str] = (),
    lasts: Sequence[str] = (),
    totals: bool = False,
    maxes: Sequence[str] = (),
) -> DataFrame:
    """Inclusive running sums (``cum_x``), maxima (``max_x``) and last non-NULL values (``last_x``).

    ``segment`` must not decrease along ``order`` inside a key. With ``totals``
    the group totals come along as ``tot_x``. NULL is a key like
    any other.
    """
    df = df.dropna(subset=[segment])
    inside = (
        Window.partitionBy(*keys, segment).orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    before = (
        Window.partitionBy(*(keys or [F.lit(0)])).orderBy(segment)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    whole = Window.partitionBy(*(keys or [F.lit(0)]))
    per_segment = df.groupBy(*keys, segment).agg(
        *[F.sum(c).alias(f"__s_{c}") for c in sums],
        *[F.max(c).alias(f"__m_{c}") for c in maxes],
        *[
            F.max(F.when(F.col(c).isNotNull(), F.struct(*order, F.col(c).alias("__v")))).alias(f"__l_{c}")
            for c in lasts
        ],
    )
    carry = per_segment.select(
        *keys,
        segment,
        *[F.coalesce(F.sum(f"__s_{c}").over(before), F.lit(0)).alias(f"__b_{c}") for c in sums],
        *([F.sum(f"__s_{c}").over(whole).alias(f"tot_{c}") for c in sums] if totals else []),
        *[F.max(f"__m_{c}").over(before).alias(f"__q_{c}") for c in maxes],
        *[F.last(f"__l_{c}", True).over(before)["__v"].alias(f"__p_{c}") for c in lasts],
    )
    joined = join_null_safe(df, carry, [*keys, segment], "inner")
    return joined.select(
        *df.columns,
        *[(F.sum(c).over(inside) + F.col(f"__b_{c}")).alias(f"cum_{c}") for c in sums],
        *([F.col(f"tot_{c}") for c in sums] if totals else []),
        *[F.greatest(F.max(c).over(inside), F.col(f"__q_{c}")).alias(f"max_{c}") for c in maxes],
        *[F.coalesce(F.last(c, True).over(inside), F.col(f"__p_{c}")).alias(f"last_{c}") for c in lasts],
    )


def calendar_day(t: str) -> Column:
    """Time segment of a subject: a calendar day, so both levels have a bound."""
    return F.to_date(F.col(t))


def asof_backward(
    left: DataFrame, right: DataFrame, by: str, left_time: str, right_time: str,
    payload: Sequence[str], inclusive: bool = True,
) -> DataFrame:
    """Latest ``right`` row at or before each ``left`` row, by key.

    ``left`` is any table with ``by`` and ``left_time``; ``right`` is unique per
    (by, right_time). The search runs on the distinct times only, so a time
    shared by very many rows costs one row.
    """
    pack = F.struct(F.col(right_time), *[F.col(c) for c in payload])
    shape = right.select(by, F.col(right_time).alias("__t"), pack.alias("__m"))
    # A tie must see the right row first, or last when the bound is strict.
    right_side, left_side = (0, 1) if inclusive else (1, 0)
    grid = left.select(by, F.col(left_time).alias("__t")).distinct()
    both = grid.select(
        by, "__t", F.lit(left_side).alias("__side"), F.lit(None).cast(shape.schema["__m"].dataType).alias("__m")
    ).unionByName(shape.withColumn("__side", F.lit(right_side)))
    matched = (
        running(both.withColumn("__day", calendar_day("__t")), [by], ["__t", "__side"], "__day", lasts=["__m"])
        .filter(F.col("__side") == left_side)
        .select(by, F.col("__t").alias(left_time), F.col("last___m").alias("__m"))
    )
    return left.join(matched, [by, left_time], "left").select(
        *left.columns, F.col(f"__m.{right_time}").alias(right_time),
        *[F.col(f"__m.{c}").alias(c) for c in payload],
    )


def global_row_number(df: DataFrame, order: Sequence[Column], out: str = "row_number") -> DataFrame:
    """1..n over a total order, from a distributed sort.

    The sorted table is written once: its row ids carry the partition in the
    high bits and the place inside it in the low 33 bits, and the only window
    runs over one row per partition.
    """
    ranked = materialize(df.orderBy(*order).withColumn("__id", F.monotonically_increasing_id()))
    ranked = ranked.withColumn("__part", F.shiftright("__id", 33)).withColumn(
        "__place", F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    )
    before = Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranked.groupBy("__part").count()
        .select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__offset"))
    )
    # One row per partition of the sort.
    return ranked.join(F.broadcast(offsets), "__part").select(
        *df.columns, (F.col("__offset") + F.col("__place") + 1).alias(out)
    )


def value_table(
    df: DataFrame, keys: Sequence[str], value: str, splits: Sequence[float] | None = None,
) -> DataFrame:
    """Distinct values per group with their count ``w``, running count and total."""
    rows = df.filter(F.col(value).isNotNull())
    if splits is None:
        splits = fit_splits(rows, [value])[value]
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("w"))
    return running(add_segment(counts, value, splits, "__seg"), keys, [value], "__seg", ["w"], totals=True)


def exact_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, quantiles: Mapping[str, float],
    kind: str = "linear", splits: Sequence[float] | None = None,
) -> DataFrame:
    """Exact group percentiles without holding a group's values in one buffer.

    ``linear`` interpolates between neighbours, ``nearest`` takes the value at
    the rounded position (an exact half rounds up).
    """
    table = value_table(df, keys, value, splits)
    first = F.col("cum_w") - F.col("w")

    def at(position: Column) -> Column:
        hit = (first <= position) & (position < F.col("cum_w"))
        return F.max(F.when(hit, F.col(value).cast("double")))

    picks, outs = [], []
    for name, q in quantiles.items():
        pos = (F.col("tot_w") - 1) * F.lit(float(q))
        if kind == "nearest":
            picks.append(at(F.floor(pos + 0.5)).alias(name))
            outs.append(F.col(name))
        else:
            picks += [
                at(F.floor(pos)).alias(f"__lo_{name}"), at(F.ceil(pos)).alias(f"__hi_{name}"),
                F.max(pos - F.floor(pos)).alias(f"__fr_{name}"),
            ]
            lo, hi = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
            outs.append((lo + (hi - lo) * F.col(f"__fr_{name}")).alias(name))
    return table.groupBy(*keys).agg(*picks).select(*keys, *outs)


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Rank with ties averaged, per group; NULL values have no rank."""
    table = value_table(df, keys, value).select(
        *keys, value, (F.col("cum_w") - F.col("w") + (F.col("w") + 1) / 2).alias(out)
    )
    return join_null_safe(df, table, [*keys, value]).select(*df.columns, out)


def keep_by_order(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key under ``order``; partial limits run before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")
