"""Pack token pieces into sequences of a fixed length by the sum-of-squares rule.

Of all open bins and a new one, a piece goes where the sum over gaps of
(number of open bins with that gap) squared becomes smallest. That keeps the
gaps spread out, so a fitting one is at hand for most pieces. Pieces come by
falling length in steps of ``STEP`` tokens, mixed within a step, so the gaps
vary and small pieces fill the last ones.

Pieces are dealt by hash into groups of about ``GROUP_PIECES``; each group is
packed on its own, so no task grows with the corpus, and a group leaves at
most a few sequences unfilled.
"""

from __future__ import annotations

import gc
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from eraloom.llm.common import arrow_rows, collector_off, forget, forgettable
from eraloom.llm.bpe import Encoder, piece_bytes
from eraloom.session import materialize

CAPACITY = 2048
# Token that ends each document.
END_ID = 0
# Pieces that one task packs; below, a group wastes well under one part in a hundred.
GROUP_PIECES = 4096
STEP = 64
# Documents that a Python worker gets at a time: whole texts lie in the JVM, in Arrow and in Python at once.
BATCH_DOCS = 1_000


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    """Kept by a worker from task to task."""
    return Encoder(piece_bytes(path), lambda ids: ids)


forgettable(_encoder)


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: ``doc_id``, ``piece`` (from 0), ``start``, ``length`` and ``ids_crc32``.

    A document is its token ids followed by ``END_ID``; null and empty texts
    are that one id. Documents longer than ``capacity`` are cut into pieces of
    that length, the last may be shorter; others are one piece. The checksum is
    over the piece's ids as unsigned little-endian 32-bit numbers.
    """

    @F.pandas_udf("array<struct<piece int, start long, length long, ids_crc32 long>>")
    def cut(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        with collector_off():  # many small objects and no cycles
            enc = _encoder(path)
            end, step = np.array([END_ID], dtype="<u4").tobytes(), 4 * capacity
            for s in series:
                rows = []
                for block in enc.blocks(s):
                    for parts in block:
                        data = b"".join(parts) + end
                        rows.append([
                            (k, at // 4, (min(at + step, len(data)) - at) // 4, zlib.crc32(data[at : at + step]))
                            for k, at in enumerate(range(0, len(data), step))
                        ])
                yield pd.Series(rows, dtype=object)
                gc.collect()

    return docs.select("doc_id", F.explode(cut("text")).alias("p")).select("doc_id", "p.*")


def sum_of_squares(lengths: list[int], capacity: int = CAPACITY) -> tuple[list[int], list[int]]:
    """Bin and offset of each length, placed in the given order; bins are numbered as they open."""
    counts = np.zeros(capacity + 1, dtype=np.int64)  # open bins by gap
    bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # the bins themselves
    where, offset, opened = [], [], 0
    for size in lengths:
        if not 0 < size <= capacity:
            raise ValueError(f"length {size} does not fit a sequence of {capacity}")
        # Change of the sum for a bin with gap g = size, size + 1, ..., capacity - 1.
        from_, to = counts[size:capacity], counts[: capacity - size]
        change = 2 * (to - from_) + 2
        if len(change):
            change[0] = 1 - 2 * from_[0]  # a full bin leaves the sum
            change = np.where(from_ > 0, change, np.iinfo(np.int64).max)
        left = capacity - size
        fresh = 2 * counts[left] + 1 if left else 0
        at = int(change.argmin()) if len(change) else -1
        if at >= 0 and change[at] <= fresh and from_[at] > 0:
            gap = size + at
            b = bins[gap].pop()
            counts[gap] -= 1
        else:
            gap, b, opened = capacity, opened, opened + 1
        if gap > size:
            bins[gap - size].append(b)
            counts[gap - size] += 1
        where.append(b)
        offset.append(capacity - gap)
    return where, offset


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: its sequence and its place there, without gaps from 0.

    Every row is kept and placed on its own, repeated rows too. The result does
    not depend on how the rows arrive, so a task that runs again packs alike.
    """
    with arrow_rows(pieces.sparkSession, BATCH_DOCS):
        pieces = materialize(pieces.select("doc_id", "piece", "start", "length", "ids_crc32"))
    groups = max(1, -(-pieces.count() // group_pieces))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        forget()  # the encoding is over
        pdf["step"] = -(pdf["length"] // STEP)
        pdf = pdf.sort_values(["step", "ids_crc32", "length", "doc_id", "piece"], kind="stable", ignore_index=True).drop(columns="step")
        where, offset = sum_of_squares(pdf["length"].tolist(), capacity)
        pdf["sequence_id"] = pdf.pop("group").astype("int64") * 2**32 + np.array(where, dtype=np.int64)
        pdf["offset"] = np.array(offset, dtype=np.int64)
        return pdf

    kind = dict(pieces.dtypes)["doc_id"]
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64(F.lit("pack"), "doc_id", "piece"), F.lit(groups)).cast("int"))
    return (
        dealt.repartition(groups, "group")
        .groupBy("group")
        .applyInPandas(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    )


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Token pieces of all documents with their places in sequences of at most ``capacity`` tokens.

    A null ``doc_id`` stays null; columns other than ``doc_id`` and ``text``
    are ignored; an empty table gives an empty result.
    """
    return pack(token_pieces(docs, path, capacity), capacity)
