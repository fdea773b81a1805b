"""Pack token streams of several sources into windows with a target mixture.

Each source is a queue of tokens. A window is filled by going round the queues:
a queue's deficit grows by its share of the window, it hands over the whole
tokens that it owes, and what it still owes is carried to the next window. The
token that no queue owes in full goes to the queue that is furthest behind for
its share, so every window is exactly full.

What a queue has handed over after a number of tokens depends on the shares
only (``Schedule.served``). So the deficits that one partition would leave to
the next are known without packing either, and every document finds its
windows from its own place in its queue. Documents are cut where a queue's
turn ends.

With the corpus' own proportions all queues end together. With other targets
a queue that ends early leaves its share to the others.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heapify, heapreplace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from eraloom.llm.common import arrow_rows
from eraloom.session import materialize

WINDOW = 1024
# Token that ends each document.
END_ID = 0
# Most queues: the sources with most tokens have one each, the others share the last. A window of 1,024 tokens
# has about four for a source with a 256th of all.
QUEUES = 256
# Documents that Python gets at a time.
BATCH_DOCS = 200
# Windows whose borders are worked out together.
BLOCK = 256
# Scale of due times: above the square of any number of tokens.
FINE = 2**160

# Fixed values of byte-level vocabularies: the word pattern of their pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


# --- tokens ------------------------------------------------------------------


def _byte_of() -> dict[str, int]:
    """The byte behind each printable letter of a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=1)
def encoder(path: str) -> tuple[Callable[[str], np.ndarray], int]:
    """A function from a text to its token ids, and the number of ids.

    A plain byte-level vocabulary, whose ids follow the order of its merges,
    goes through ``tiktoken``, which gives the same ids in a third of the time;
    any other file, and texts on which its pattern gives up (a million spaces),
    through ``tokenizers``.
    """
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(path)
    exact.no_truncation()
    exact.no_padding()
    size = exact.get_vocab_size(with_added_tokens=True)

    def slow(text: str) -> np.ndarray:
        return np.array(exact.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, vocab, added = spec["model"], spec["model"].get("vocab"), spec["added_tokens"]
    pre = spec["pre_tokenizer"] or {}
    plain = (
        model["type"] == "BPE" and spec["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        and not any(a[k] for a in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
    )
    if plain:
        pairs = [p.split(" ") if isinstance(p, str) else p for p in model["merges"]]
        plain = [vocab["".join(p)] for p in pairs] == list(range(256, 256 + len(pairs)))
    if not plain:
        return slow, size
    import tiktoken

    letter = _byte_of()
    special = {a["content"]: a["id"] for a in added}
    ranks = {bytes(letter[c] for c in t): i for t, i in vocab.items() if t not in special}
    quick = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def fast(text: str) -> np.ndarray:
        try:
            return quick.encode_to_numpy(text, allowed_special="all")
        except ValueError:  # the pattern's stack is exhausted
            return slow(text)

    return fast, size


def token_table(docs: DataFrame, path: str) -> DataFrame:
    """One row per document: ``doc_id``, ``source``, ``ids``, ``n``, and its place ``at`` among the tokens of its source in the part ``part``.

    ``ids`` are little-endian, two bytes each where the vocabulary allows it,
    ``END_ID`` included. Parts are the tasks that write the table: a task that
    runs again reads the same rows and counts alike.
    """
    kind = docs.schema["doc_id"].dataType

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, size = encoder(path)
        width = np.dtype("<u2" if size <= 2**16 else "<u4")
        end = np.array([END_ID], dtype=width)
        part = TaskContext.get().partitionId()
        so_far: dict = {}
        for batch in batches:
            doc, source, text = batch.columns
            ids, n, at = [], [], []
            for t, s in zip(text, source.to_pylist()):
                t = t.as_py()
                x = np.r_[ids_of(t).astype(width), end] if t else end
                ids.append(x.tobytes())
                n.append(len(x))
                at.append(so_far.get(s, 0))
                so_far[s] = at[-1] + len(x)
            yield pa.RecordBatch.from_arrays(
                [doc, source, pa.array(ids, pa.binary()), pa.array(n, pa.int64()), pa.array(at, pa.int64()), pa.array([part] * len(n), pa.int32())],
                ["doc_id", "source", "ids", "n", "at", "part"],
            )

    schema = T.StructType([
        T.StructField("doc_id", kind), T.StructField("source", T.StringType()), T.StructField("ids", T.BinaryType()), T.StructField("n", T.LongType()),
        T.StructField("at", T.LongType()), T.StructField("part", T.IntegerType()),
    ])
    with arrow_rows(docs.sparkSession, BATCH_DOCS):
        return materialize(docs.select("doc_id", F.col("source").cast("string").alias("source"), "text").mapInArrow(encode, schema))


# --- the schedule ------------------------------------------------------------


class Schedule:
    """How many tokens each queue has handed over at any time.

    ``tokens`` are the queues' lengths, ``shares`` their targets as whole
    numbers. Of the first t tokens of a phase a queue hands over its share,
    rounded so that they add up to t: the token in question goes to the queue
    whose next token is due first, the k-th one of a share w at (2k - 1) / 2w.
    What was handed over never falls with t. A phase ends when a queue has no
    token left for its turn; the next phase has the shares of the others.
    """

    def __init__(self, tokens: list[int], shares: list[int]):
        if len(tokens) != len(shares) or min(tokens, default=0) < 0 or min(shares, default=0) < 0:
            raise ValueError("one share, at least 0, for each queue")
        self.total, self.queues = sum(tokens), len(tokens)
        self.phases: list[tuple[int, list[int], list[int]]] = []  # first token, handed over before, shares
        base = [0] * len(tokens)
        while (at := sum(base)) < self.total:
            left = [n - b for n, b in zip(tokens, base)]
            active = [w if r else 0 for w, r in zip(shares, left)]
            if not any(active):  # queues without a target come last
                active = [r for r in left]
            low, high = 0, self.total - at  # most tokens of this phase that all queues can meet
            while low < high:
                mid = (low + high + 1) // 2
                if all(s <= r for s, r in zip(self._split(active, mid), left)):
                    low = mid
                else:
                    high = mid - 1
            self.phases.append((at, base, active))
            base = [b + s for b, s in zip(base, self._split(active, low))]
        self.starts = [p[0] for p in self.phases]

    @staticmethod
    def _split(shares: list[int], t: int) -> list[int]:
        whole = sum(shares)
        out = [(2 * t * w + whole) // (2 * whole) for w in shares]
        spare = t - sum(out)
        # Due times as whole numbers, fine enough to tell any two fractions apart; equal ones go by queue.
        if spare > 0:  # the earliest tokens not yet handed over
            heap = [((2 * n + 1) * FINE // w, j) for j, (n, w) in enumerate(zip(out, shares)) if w]
            heapify(heap)
            for _ in range(spare):
                j = heap[0][1]
                out[j] += 1
                heapreplace(heap, ((2 * out[j] + 1) * FINE // shares[j], j))
        elif spare < 0:  # the latest ones handed over
            heap = [(-((2 * n - 1) * FINE // w), -j) for j, (n, w) in enumerate(zip(out, shares)) if n]
            heapify(heap)
            for _ in range(-spare):
                j = -heap[0][1]
                out[j] -= 1
                heapreplace(heap, (-((2 * out[j] - 1) * FINE // shares[j]), -j))
        return out

    def served(self, t: int) -> tuple[int, ...]:
        """Tokens that each queue has handed over among the first ``t``."""
        t = min(t, self.total)
        if t == 0:
            return (0,) * self.queues
        at, base, shares = self.phases[bisect_right(self.starts, t - 1) - 1]
        return tuple(b + s for b, s in zip(base, self._split(shares, t - at)))

    def guess(self, queue: int, place: int) -> int:
        """About when the token at ``place`` of a queue is handed over."""
        f = bisect_right([p[1][queue] for p in self.phases], place) - 1
        at, base, shares = self.phases[f]
        return at + (place - base[queue]) * sum(shares) // (shares[queue] or 1)

    def windows(self, window: int) -> int:
        return -(-self.total // window)


class Windows:
    """A schedule's windows: where each queue's tokens stand, as window and offset.

    All windows are full but the last, which is cut into sequences whose
    lengths are powers of two, so no sequence needs padding. Window borders are
    worked out ``BLOCK`` windows at a time and kept while they are in use.
    """

    def __init__(self, schedule: Schedule, window: int):
        self.schedule, self.window = schedule, window
        self.last = schedule.windows(window) - 1
        rest = schedule.total - self.last * window
        self.cuts = [0]
        if rest < window:
            for bit in reversed(range(rest.bit_length())):
                if rest >> bit & 1:
                    self.cuts.append(self.cuts[-1] + (1 << bit))
        self.block = lru_cache(maxsize=64)(self._block)

    def _block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Tokens that each queue has handed over when each window of a block begins and the last one ends, and the same of all queues before it."""
        served = np.array([self.schedule.served(k * self.window) for k in range(b * BLOCK, (b + 1) * BLOCK + 1)], dtype=np.int64)
        return served, np.cumsum(served, axis=1) - served

    def _window_of(self, queue: int, place: int) -> int:
        k = min(self.schedule.guess(queue, place) // self.window, self.last)
        b = k // BLOCK
        while (at := self.block(b)[0][:, queue])[0] > place:
            b -= 1
        while at[-1] <= place:
            b += 1
            at = self.block(b)[0][:, queue]
        return b * BLOCK + int(np.searchsorted(at, place, side="right")) - 1

    def pieces(self, queue: int, first: int, n: int) -> tuple[np.ndarray, ...]:
        """Start, length, sequence and offset of the pieces of a document: ``n`` tokens of ``queue`` from place ``first``."""
        k, end, found = self._window_of(queue, first), first + n, []
        while True:
            b = k // BLOCK
            served, before = self.block(b)
            i = k - b * BLOCK
            j = max(i + 1, int(np.searchsorted(served[:, queue], end, side="left")))
            edges = served[i : min(j, BLOCK) + 1, queue]
            starts, ends = np.maximum(edges[:-1], first), np.minimum(edges[1:], end)
            turn = np.diff(before[i : min(j, BLOCK) + 1, queue])
            full = ends > starts
            found.append((starts - first, ends - starts, np.arange(k, k + len(starts)), turn + starts - edges[:-1], full))
            if j <= BLOCK:
                break
            k = (b + 1) * BLOCK
        start, length, sequence, offset, full = map(np.concatenate, zip(*found)) if len(found) > 1 else found[0]
        start, length, sequence, offset = (x[full] for x in (start, length, sequence, offset))
        if len(self.cuts) == 1 or sequence[-1] < self.last:
            return start, length, sequence, offset
        tail = list(self._cut(int(start[-1]), int(length[-1]), int(offset[-1])))
        return tuple(np.r_[x[:-1], np.array(y, dtype=np.int64)] for x, y in zip((start, length, sequence, offset), zip(*tail)))

    def _cut(self, start: int, length: int, at: int) -> Iterator[tuple[int, int, int, int]]:
        """A piece of the last window, cut where its sequences end."""
        while length:
            i = bisect_right(self.cuts, at) - 1
            take = min(length, self.cuts[i + 1] - at)
            yield start, take, self.last + i, at - self.cuts[i]
            start, length, at = start + take, length - take, at + take


# --- Spark -------------------------------------------------------------------


def _queues(tokens: DataFrame, targets: dict[str | None, float] | None) -> tuple[list[str | None], list[int], list[int]]:
    """Names of the queues but the last, and lengths and shares of all; the last holds every other source."""
    per_source = tokens.groupBy("source").agg(F.sum("n").alias("n"))
    if targets is None:
        top = per_source.orderBy(F.desc("n"), "source").limit(QUEUES - 1).collect()
    else:
        if len(targets) >= QUEUES or min(targets.values(), default=0) < 0:
            raise ValueError(f"targets: fewer than {QUEUES} sources with shares of at least 0")
        wanted = list(targets)
        listed = F.col("source").isin([s for s in wanted if s is not None]) | (F.col("source").isNull() if None in targets else F.lit(False))
        top = per_source.where(F.coalesce(listed, F.lit(False))).collect()
    total = tokens.agg(F.sum("n")).first()[0] or 0
    names, lengths = [r["source"] for r in top], [r["n"] for r in top]
    lengths.append(total - sum(lengths))
    if targets is None:
        return names, lengths, lengths
    return names, lengths, [*(round(targets[s] * 2**30) for s in names), 0]


def pack(tokens: DataFrame, targets: dict[str | None, float] | None = None, window: int = WINDOW) -> DataFrame:
    """Pieces of the documents of ``token_table`` with their places in sequences."""
    spark = tokens.sparkSession
    names, lengths, shares = _queues(tokens, targets)
    listed = spark.createDataFrame([(s, i) for i, s in enumerate(names)], "name string, queue int")
    # Where each part's tokens of a source begin in their queue: one row per source and part.
    parts = tokens.groupBy("source", "part").agg(F.sum("n").alias("n")).join(F.broadcast(listed), F.col("source").eqNullSafe(F.col("name")), "left")
    parts = parts.withColumn("queue", F.coalesce("queue", F.lit(len(names))))
    before = F.sum("n").over(Window.partitionBy("queue").orderBy("source", "part").rowsBetween(Window.unboundedPreceding, -1))
    parts = materialize(parts.select("source", "part", "queue", F.coalesce(before, F.lit(0)).alias("base")))
    begins = parts.select(F.col("source").alias("_source"), F.col("part").alias("_part"), "queue", "base")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(Schedule(lengths, shares), window)
        for batch in batches:
            doc, source, n = batch.column(0), batch.column(1), batch.column(3)
            found, sums = [], []
            for data, count, q, x in zip(batch.column(2), n.to_pylist(), batch.column(4).to_pylist(), batch.column(5).to_pylist()):
                raw = data.as_buffer()
                wide = memoryview(np.frombuffer(raw, dtype="<u2" if raw.size == 2 * count else "<u4").astype("<u4").tobytes())
                found.append(windows.pieces(q, x, count))
                at = (4 * found[-1][0]).tolist()
                sums += [zlib.crc32(wide[a:b]) for a, b in zip(at, [*at[1:], 4 * count])]
            if found:
                start, length, sequence, offset = (np.concatenate(x) for x in zip(*found))
                of = pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found]))
                columns = [doc.take(of), pa.array(start), pa.array(length), pa.array(sums, pa.int64()), n.take(of), pa.array(sequence), pa.array(offset), source.take(of)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"])

    placed = tokens.join(begins, F.col("source").eqNullSafe(F.col("_source")) & (F.col("part") == F.col("_part")))
    kind = dict(tokens.dtypes)["doc_id"]
    return placed.select("doc_id", "source", "ids", "n", "queue", (F.col("base") + F.col("at")).alias("first")).mapInArrow(
        cut, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"
    )


def pack_documents(docs: DataFrame, path: str, targets: dict[str | None, float] | None = None, window: int = WINDOW) -> DataFrame:
    """Token pieces of all documents, with their places in sequences of ``window`` tokens that keep to the targets.

    A document is its token ids followed by ``END_ID``; null and empty texts
    are that one id. ``targets`` maps sources to shares of the tokens, for as
    long as they last; sources without one come last. Without ``targets`` each
    source's share of all tokens is its target, so every window has the
    corpus' mixture. Each id lies in exactly one piece. All sequences have
    ``window`` tokens but the last ones, whose lengths are powers of two.

    Every row is a document, repeated rows too; a null ``doc_id`` stays null, a
    null ``source`` is a source of its own. Columns other than ``doc_id``,
    ``source`` and ``text`` are ignored; an empty table gives an empty result.
    """
    return pack(token_table(docs, path), targets, window)
