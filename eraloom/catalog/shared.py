"""Helpers for registered queries and the SQL fragments their checks share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from eraloom.plans.dataset import Representation, Timeline, prepare
from eraloom.session import materialize
from eraloom.sources import adapters

CONTEXT = 64
RAW = Representation("raw_64", "raw", "raw", CONTEXT)
BACKFILL = Representation("condition_era_90_backfill_64", "condition_era", "backfill", CONTEXT, 90)
NO_BACKFILL = Representation("condition_era_90_no_backfill_64", "condition_era", "no_backfill", CONTEXT, 90)
STRUCTURE_NULL = Representation("condition_era_90_structure_null_64", "condition_era", "structure_null", CONTEXT, 90)

_made: dict = {}


def once(spark: SparkSession, sf_dir: str, name: str, make):
    """Share a costly written table between queries of one session."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _made:
        _made[key] = make()
    return _made[key]


def forget() -> None:
    _made.clear()


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a user would have it: one parquet table."""
    return once(spark, sf_dir, "events", lambda: materialize(adapters.clinical_events(spark, sf_dir)))


def timeline(spark: SparkSession, sf_dir: str) -> Timeline:
    return once(spark, sf_dir, "timeline", lambda: prepare(
        events(spark, sf_dir), adapters.episode_labels(spark, sf_dir), adapters.code_list(spark)
    ))


def base_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline(spark, sf_dir).ranked.drop("is_compressible", "event_rank", "plain_rank")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "scores", lambda: materialize(adapters.scores(spark, sf_dir)))


def r(c, digits: int = 6) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), digits)


def rounded(df: DataFrame, digits: int = 6, ints: tuple[str, ...] = ()) -> DataFrame:
    """Doubles rounded, booleans as 0/1, chosen columns as long."""
    cols = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if name in ints or kind in ("int", "tinyint", "smallint", "bigint"):
            c = c.cast("long")
        elif kind in ("double", "float"):
            c = F.round(c.cast("double"), digits)
        elif kind == "boolean":
            c = c.cast("long")
        cols.append(c.alias(name))
    return df.select(*cols)


EV = """
splits as (select c_custkey as subject_id,
    case when c_custkey % 10 < 7 then 'train' when c_custkey % 10 = 7 then 'tuning' else 'held_out' end as split from customer),
sold as (select o_custkey, o_orderdate, l.*, p_type, p_brand,
    cast(round(l_extendedprice * 100) as bigint) as cents
    from lineitem l join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey),
ev as (
    select o_custkey as subject_id, o_orderdate as time, 'Visit/' || o_orderpriority as code,
        'visit_occurrence' as omop_table, cast(null as float) as numeric_value, cast(null as varchar) as text_value,
        cast('0x' || substr(sha256(concat_ws('|', o_orderkey::varchar, 'v')), 1, 13) as bigint) as source_event_id from orders
    union all
    select o_custkey, o_orderdate + to_minutes(299 * l_linenumber), 'DX/' || p_type, 'condition_occurrence', cast(null as float), l_returnflag,
        cast('0x' || substr(sha256(concat_ws('|', l_orderkey::varchar, 'd', l_linenumber::varchar, l_partkey::varchar, l_suppkey::varchar, cents::varchar)), 1, 13) as bigint) from sold
    union all
    select o_custkey, l_shipdate, 'LAB/' || p_brand, 'measurement', cast(l_quantity as float), l_linestatus,
        cast('0x' || substr(sha256(concat_ws('|', l_orderkey::varchar, 'm', l_linenumber::varchar, l_partkey::varchar, l_suppkey::varchar, cents::varchar)), 1, 13) as bigint) from sold),
labels as (select 'order_f' as task, o_orderkey as row_id, o_custkey as subject_id, o_orderdate as prediction_time,
    cast(o_orderstatus = 'F' as int) as label,
    case when o_custkey % 10 < 7 then 'train' when o_custkey % 10 = 7 then 'tuning' else 'held_out' end as split from orders)
"""
BASE = EV + """,
anchors as (select subject_id, visit_time, row_number() over (partition by subject_id order by visit_time) - 1 as visit_index
    from (select distinct subject_id, time as visit_time from ev where code like 'Visit/%' and omop_table = 'visit_occurrence')),
base as (select e.*, case when date_sub('hour', a.visit_time, e.time) / 24.0 <= 1 then 'reconstructed_visit=' || a.visit_index
    else 'day=' || strftime(e.time, '%Y-%m-%d') end as compression_bucket
    from ev e asof left join anchors a on e.subject_id = a.subject_id and e.time >= a.visit_time)
"""
HIST = BASE + """,
history as (select l.*, b.time, b.code, b.numeric_value, b.text_value, b.compression_bucket, b.source_event_id,
    cast(date_sub('day', b.time, l.prediction_time) as double) as days_before_prediction
    from labels l join base b on l.subject_id = b.subject_id and b.time <= l.prediction_time)
"""
LISTED = "('DX/ECONOMY','DX/PROMO','DX/STANDARD')"


def era_sql(source: str, suffix: str = "", keys: str = "row_id", gap: int = 90) -> str:
    """CTEs compressing history table ``source`` into ``tokens<suffix>``."""
    s = suffix
    bin_ = "case when n_points <= 1 then '1' when n_points = 2 then '2' when n_points <= 5 then '3_5' when n_points <= 10 then '6_10' else 'gt10' end"
    key_cols = ", ".join(f"{k}" for k in keys.split(", "))
    return f""",
points{s} as (select {key_cols}, any_value(prediction_time) as prediction_time, code, compression_bucket, count(*) as n,
    min(time) as time, arg_min(source_event_id, (time, source_event_id)) as source_event_id,
    first(text_value order by time, source_event_id) as text_value
    from {source} where code in {LISTED} group by {key_cols}, code, compression_bucket),
gaps{s} as (select *, lag(time) over (partition by {key_cols}, code order by time, source_event_id) as prev from points{s}),
eras{s} as (select *, sum(case when prev is null or date_sub('day', prev, time) > {gap} then 1 else 0 end)
    over (partition by {key_cols}, code order by time, source_event_id) - 1 as era from gaps{s}),
summary{s} as (select {key_cols}, any_value(prediction_time) as prediction_time, code, era, count(*) as n_points, sum(n)::bigint as n_mentions,
    min(time) as t0, max(time) as t1, first(source_event_id order by time) as a0, last(source_event_id order by time) as a1,
    first(text_value order by time) as x0, date_sub('day', min(time), max(time)) as span from eras{s} group by {key_cols}, code, era),
tokens{s} as (
    select {key_cols}, prediction_time, time, code, cast(numeric_value as double) as numeric_value, text_value, days_before_prediction, false as state,
        source_event_id as anchor, 0 as role, 0 as a_persist, 0 as a_rep, 0 as a_dup, 0 as a_era, 0 as a_eras, 0 as a_comp
        from {source} where code not in {LISTED}
    union all select {key_cols}, prediction_time, t0, code, null, x0, date_sub('day', t0, prediction_time), false, a0, 0,
        n_mentions, n_mentions - 1, n_mentions - n_points, n_points - 1, 1, 0 from summary{s} where n_points = 1
    union all select {key_cols}, prediction_time, t0, 'DX_ERA{gap}_START/' || code, 0, null, date_sub('day', t0, prediction_time), true, a0, 10,
        n_mentions, n_mentions - 1, n_mentions - n_points, n_points - 1, 1, 1 from summary{s} where n_points > 1
    union all select {key_cols}, prediction_time, t1, 'DX_ERA{gap}_END/' || code, span, null, date_sub('day', t1, prediction_time), true, a1, 20,
        0, 0, 0, 0, 0, 0 from summary{s} where n_points > 1
    union all select {key_cols}, prediction_time, t1, 'DX_ERA{gap}_COUNT_BIN/' || {bin_} || '/' || code, n_points, null,
        date_sub('day', t1, prediction_time), true, a1, 30, 0, 0, 0, 0, 0, 0 from summary{s} where n_points > 1)
"""


def last_n_sql(source: str, out: str, keys: str = "row_id", n: int = CONTEXT) -> str:
    return f""",
{out} as (select * exclude (back), row_number() over (partition by {keys} order by time, anchor, role, code) as pos from (
    select *, row_number() over (partition by {keys} order by time desc, anchor desc, role desc, code desc) as back from {source}) where back <= {n})
"""


RAW_LONG = HIST + """,
raw_tokens as (select row_id, prediction_time, time, code, cast(numeric_value as double) as numeric_value, text_value, days_before_prediction,
    false as state, source_event_id as anchor, 0 as role from history)
""" + last_n_sql("raw_tokens", "raw_long")
BACKFILL_LONG = HIST + era_sql("history") + last_n_sql("tokens", "long")
WINDOW = HIST + """,
win as (select * exclude (back) from (select *, row_number() over (partition by row_id order by time desc, source_event_id desc, code desc) as back
    from history) where back <= 64)
"""
NO_BACKFILL_LONG = WINDOW + era_sql("win", "_nb") + last_n_sql("tokens_nb", "long_nb")

SCORES = """
scores as (select *, 1 / (1 + exp(-least(greatest(logit, -30), 30))) as risk_raw, 1 / (1 + exp(-(cast(0.9 as double) * logit - cast(0.1 as double)))) as risk_calibrated from (
    select 'order_f' as task, v.version as compression_version, s.seed, f.fraction as requested_copy_fraction,
        case when o_custkey % 10 < 7 then 'train' when o_custkey % 10 = 7 then 'tuning' else 'held_out' end as split,
        o_orderkey as row_id, o_custkey as subject_id, o_orderdate as prediction_time, cast(o_orderstatus = 'F' as int) as y_true,
        round(cast(-0.7 as double) + cast(0.6 as double) * cast(o_orderstatus = 'F' as int)
        + (cast((o_orderkey * 7919 + s.seed * 104729 + v.vid * 1299709) % 1000 as double) / cast(500 as double) - cast(1 as double))
        + f.fraction * cast(0.05 as double) * cast(v.vid + 1 as double) * cast((o_orderkey % 7) - 3 as double), 6) as logit
    from orders
    cross join (values ('raw_64', 0), ('condition_era_90_backfill_64', 1)) as v(version, vid)
    cross join (values (42), (43), (44), (45), (46)) as s(seed)
    cross join (values (cast(0.0 as double)), (cast(0.25 as double)), (cast(0.5 as double)), (cast(1.0 as double))) as f(fraction)))
"""
