"""Vocabulary, token sequences, numeric statistics and model features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from eraloom.functions.ordered import global_row_number
from eraloom.functions.scalar import whole_days
from eraloom.operators.eras import unpack
from eraloom.schemas import EPISODE_KEY, SPECIAL_TOKENS
from eraloom.session import BROADCAST_ROWS, broadcast_checked


def train_code_counts(long: DataFrame, min_count: int = 1) -> DataFrame:
    return (
        long.filter(F.col("split") == "train").groupBy("code").agg(F.count("*").alias("n"))
        .filter(F.col("n") >= min_count)
    )


def build_vocab(long: DataFrame, min_count: int = 1, max_size: int | None = None) -> DataFrame:
    """Token ids by falling training count, then code; ids 0 to 2 are special."""
    placed = global_row_number(train_code_counts(long, min_count), [F.desc("n"), F.asc("code")])
    if max_size is not None:
        placed = placed.filter(F.col("row_number") <= max(0, max_size - len(SPECIAL_TOKENS)))
    words = placed.select("code", (F.col("row_number") + len(SPECIAL_TOKENS) - 1).cast("int").alias("token_id"))
    special = long.sparkSession.createDataFrame(list(SPECIAL_TOKENS.items()), "code string, token_id int")
    return special.unionByName(words)


def encode_tokens(long: DataFrame, vocab: DataFrame) -> DataFrame:
    """Token id per row; codes outside the vocabulary become the unknown token."""
    return long.join(broadcast_checked(vocab), "code", "left").select(
        *long.columns, F.coalesce("token_id", F.lit(SPECIAL_TOKENS["<UNK>"])).alias("token_id")
    )


def collect_sequences(encoded: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Parallel arrays per episode in position order.

    A sequence is capped by the context length. Each element is one struct, so
    NULL values keep their place and day gaps come from array neighbours.
    """
    keys = keys or EPISODE_KEY
    item = F.struct(
        "event_position", "token_id", "code", "time", "days_before_prediction", "numeric_value",
        "is_compression_token", "order_anchor_id",
    )
    s = encoded.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("s"))
    pick = lambda name: F.transform("s", lambda x: x[name])
    return s.select(*keys, "s", pick("token_id").alias("token_ids"), pick("days_before_prediction").alias("days_before_prediction")).select(
        *keys, "token_ids", "days_before_prediction", *_arrays()
    )


def encode_packed(packed: DataFrame, vocab: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """The arrays of :func:`collect_sequences` from packed tokens, without moving them; ``carried`` columns come along.

    The words lie in one broadcast row, in buckets by their hash, so a token
    looks through the few words of its bucket. A vocabulary too large for that
    joins the tokens.
    """
    n = vocab.limit(BROADCAST_ROWS + 1).count()
    if n > BROADCAST_ROWS:
        found = collect_sequences(encode_tokens(unpack(packed), vocab))
        return packed.select(*EPISODE_KEY, *carried).join(found.drop(*[c for c in EPISODE_KEY if c not in ("row_id", "task")]), ["row_id", "task"], "left")
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    known = vocab.groupBy(bucket(F.col("code")).alias("b")).agg(F.collect_list(F.struct("code", "token_id")).alias("w"))
    known = known.agg(F.map_from_entries(F.collect_list(F.struct("b", "w"))).alias("m"))
    places = F.sequence(F.lit(0), F.lit(n - 1))
    words = known.select(F.transform(places, lambda i: F.col("m")[i]).alias("__words"))
    unknown = F.lit(SPECIAL_TOKENS["<UNK>"])

    def token_id(x: Column) -> Column:
        near = F.filter(F.get("__words", bucket(x["code"])), lambda w: w["code"] == x["code"])
        return F.coalesce(F.get(near, F.lit(0))["token_id"], unknown)

    s = packed.crossJoin(F.broadcast(words)).withColumn("token_ids", F.transform("s", token_id))
    days = F.transform("s", lambda x: whole_days(x["time"], F.col("prediction_time")).cast("float"))
    return s.select(*EPISODE_KEY, *carried, "token_ids", days.alias("days_before_prediction"), *_arrays())


def _arrays() -> list[Column]:
    """Columns of the array ``s`` of tokens in position order and their ``token_ids``."""

    def gap(x: Column, i: Column) -> Column:
        before = F.get(F.col("s"), i - 1)["time"]
        return F.coalesce(whole_days(before, x["time"]), F.lit(0)).cast("float")

    pick = lambda name: F.transform("s", lambda x: x[name])
    return [
        pick("code").alias("codes"), F.transform("s", gap).alias("delta_days"), pick("numeric_value").alias("numeric_values"),
        F.size("s").alias("seq_len"), F.size(F.array_distinct("token_ids")).alias("n_unique_tokens"),
        F.size(F.filter("s", lambda x: x["is_compression_token"])).alias("n_compression_events"),
        pick("time").alias("__times"), pick("order_anchor_id").alias("__anchors"),
    ]


def delta_days(long: DataFrame) -> DataFrame:
    """Whole days since the previous position, for long tables."""
    from pyspark.sql import Window

    w = Window.partitionBy("row_id", "task").orderBy("event_position")
    return long.withColumn("delta_days", F.coalesce(whole_days(F.lag("time").over(w), F.col("time")), F.lit(0)))


def token_numeric_stats(examples: DataFrame, vocab: DataFrame, min_count: int = 3) -> DataFrame:
    """Mean and population deviation of the training values per token."""
    pairs = (
        examples.filter(F.col("split") == "train")
        .select(F.explode(F.arrays_zip("token_ids", "numeric_values")).alias("p"))
        .select(F.col("p.token_ids").alias("token_id"), F.col("p.numeric_values").cast("double").alias("x"))
        .filter(F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") < float("inf")))
    )
    sums = pairs.groupBy("token_id").agg(
        F.count("*").alias("n"), F.avg("x").alias("m"), F.avg(F.col("x") * F.col("x")).alias("m2")
    )
    ok = F.coalesce(F.col("n"), F.lit(0)) >= min_count
    spread = F.sqrt(F.greatest(F.col("m2") - F.col("m") * F.col("m"), F.lit(1e-6)))
    return vocab.select("token_id").join(sums, "token_id", "left").select(
        "token_id", F.coalesce("n", F.lit(0)).alias("numeric_count_train"),
        F.when(ok, F.col("m")).otherwise(0.0).alias("numeric_mean_train"),
        F.when(ok, spread).otherwise(1.0).alias("numeric_std_train"),
        ok.alias("has_enough_numeric_stats"),
    )


def last_elements(array: str, n: int) -> Column:
    c = F.col(array)
    return F.slice(c, F.greatest(F.size(c) - n, F.lit(0)) + 1, F.lit(n))


def padded(array: str, like: str, fill: Column) -> Column:
    missing = F.greatest(F.size(like) - F.size(array), F.lit(0))
    return F.concat(F.col(array), F.array_repeat(fill, missing))


def sequence_features(examples: DataFrame, stats: DataFrame, max_len: int) -> DataFrame:
    """Model-ready arrays: log gaps, clamped z-scores and presence flags.

    Token statistics join on exploded positions, so no vocabulary-sized map is
    shipped to every row.
    """
    zeros, missing = F.lit(0.0).cast("float"), F.lit(None).cast("float")
    kept = (
        examples.select(
            *EPISODE_KEY, "token_ids",
            padded("days_before_prediction", "token_ids", zeros).alias("b"),
            padded("delta_days", "token_ids", zeros).alias("d"),
            padded("numeric_values", "token_ids", missing).alias("v"),
        )
        .select(*EPISODE_KEY, last_elements("token_ids", max_len).alias("t"),
                *[last_elements(c, max_len).alias(c) for c in "bdv"])
        .select(*EPISODE_KEY, F.posexplode_outer(F.arrays_zip("t", "b", "d", "v")).alias("pos", "e"))
        .select(*EPISODE_KEY, "pos", F.col("e.t").alias("token_id"),
                *[F.col(f"e.{c}").cast("double").alias(c) for c in "bdv"])
    )
    seen = F.col("v").isNotNull() & ~F.isnan("v")
    z = (F.col("v") - F.col("numeric_mean_train")) / F.greatest(F.col("numeric_std_train"), F.lit(1e-6))
    rows = kept.join(broadcast_checked(stats), "token_id", "left").select(
        *EPISODE_KEY, "pos", "token_id",
        F.log1p(F.greatest("b", F.lit(0.0))).alias("log_days_before"),
        F.log1p(F.greatest("d", F.lit(0.0))).alias("log_delta_days"),
        F.when(seen, F.least(F.greatest(z, F.lit(-10.0)), F.lit(10.0))).otherwise(0.0).alias("z"),
        F.when(seen, 1.0).otherwise(0.0).alias("present"),
    )
    cols = ["token_id", "log_days_before", "log_delta_days", "z", "present"]
    item = F.when(F.col("pos").isNotNull(), F.struct("pos", *cols))
    s = rows.groupBy(*EPISODE_KEY).agg(F.sort_array(F.collect_list(item)).alias("s"))
    pick = lambda c: F.transform("s", lambda x: x[c]).alias(c)
    return s.select(*EPISODE_KEY, *[pick(c) for c in cols])


def length_summary(examples: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts, event rate and length statistics, by split unless told otherwise.

    Lengths are whole numbers up to the context, so ``percentile`` keeps one
    counter per distinct length.
    """
    mean = lambda c, n: F.avg(F.col(c).cast("double")).alias(n)
    return examples.groupBy(*(by or ["split"])).agg(
        F.count("*").alias("n_examples"), F.countDistinct("subject_id").alias("n_patients"),
        F.sum("label").alias("n_positive"), mean("label", "event_rate"),
        mean("original_history_len", "mean_original_history_len"),
        mean("transformed_history_len", "mean_transformed_history_len"), mean("seq_len", "mean_seq_len"),
        F.percentile("seq_len", F.lit(0.5)).alias("median_seq_len"),
        F.percentile("seq_len", F.lit(0.9)).alias("p90_seq_len"), F.max("seq_len").alias("max_seq_len"),
        F.avg(F.col("was_truncated").cast("int")).alias("truncated_share"),
        mean("n_repeats_removed", "mean_repeats_removed"),
        mean("n_backfill_events_added", "mean_backfill_events_added"), mean("covered_days", "mean_covered_days"),
        mean("n_persistent_diagnoses", "mean_persistent_diagnoses"),
        mean("n_compression_events", "mean_compression_events"),
    )


def representation_summary(examples: DataFrame, vocab: DataFrame) -> DataFrame:
    """One metadata row per task and version, with vocabulary size and boundary check."""
    days = F.array_min("days_before_prediction")
    rows = length_summary(examples, ["task", "version"]).join(
        examples.groupBy("task", "version").agg(F.min(days).cast("double").alias("min_days_before_prediction")),
        ["task", "version"],
    )
    sizes = vocab.groupBy("task", "version").agg(F.count("*").alias("vocab_size"))
    return rows.join(sizes, ["task", "version"], "left")
