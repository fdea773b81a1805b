"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

Words that occur often in the corpus are compiled, with their token ids as
output, into an automaton that shares prefixes and suffixes. The automaton is
a flat file; every Python worker maps it into memory, so workers of one host
share its pages. A batch of words walks it one byte position at a time for all
words together. Words that it does not know are merged exactly.

The vocabulary is that of a word-level BPE file of the ``tokenizers`` library:
NFC, lower case, words by the file's pattern, bytes as printable characters, a
word end marker on the last symbol.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import re
import struct
import unicodedata
from collections import ChainMap, Counter
from collections.abc import Callable, Iterable, Iterator
from functools import cache, lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, functions as F

from eraloom.llm.common import shared_file
from eraloom.session import materialize

# Most words that the lexicon takes: the corpus' most frequent ones.
LEXICON_WORDS = 262_144
# Piece counts that a task gathers before it hands them on, and pieces whose encoding a worker remembers.
FLUSH_PIECES = 400_000
MEMO_PIECES = 700_000
# Characters of text that are encoded together.
BLOCK_CHARS = 1_000_000

# Bytes of words that are merged together with others, and the rank of pairs that don't merge.
TOGETHER = 64
NEVER = 2**31

# Fixed values of the vocabulary file: word pattern, word end and special tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
SPECIAL = {"<|startoftext|>": 49406, "<|endoftext|>": 49407}

_special = re.compile("(" + "|".join(map(re.escape, SPECIAL)) + ")")
# Control characters that Python's split takes for white space and Unicode does not.
_odd_space = re.compile("[\x1c-\x1f]")


# Letters above this range are looked for only in texts that have them: short character classes match much faster.
NEAR = 0x370
_far = re.compile(f"[^\x00-\\u{NEAR - 1:04x}]")


@cache
def _find(limit: int):
    """The word pattern with its letter and number classes written out as ranges below ``limit``; a line end is a match of its own."""

    def ranges(kind: str) -> str:
        points = [i for i in range(limit) if unicodedata.category(chr(i))[0] == kind]
        cuts = [0, *(i for i in range(1, len(points)) if points[i] != points[i - 1] + 1), len(points)]
        return "".join(f"\\U{points[a]:08x}-\\U{points[b - 1]:08x}" for a, b in zip(cuts, cuts[1:]))

    space = "\\x09-\\x0d\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
    return re.compile("\n|" + PATTERN.replace(r"\s", space).replace(r"\p{L}", ranges("L")).replace(r"\p{N}", ranges("N"))).findall


def _normal(text: str) -> str:
    if not text.isascii():
        # Lower case is taken letter by letter, so a capital sigma never becomes a final one.
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return text.lower()


def plain_words(text: str) -> list[str]:
    """Words of a text without special tokens, in order, in the vocabulary's normal form."""
    text = _normal(text)
    return [w for w in _find(0x110000 if _far.search(text) else NEAR)(text) if w != "\n"]


def words(text: str) -> list[str]:
    """Words of a text; special tokens in it stand as they are, as words of their own."""
    if "<|" not in text:
        return plain_words(text)
    out: list[str] = []
    for part in _special.split(text):
        out += [part] if part in SPECIAL else plain_words(part)
    return out


def chunks(text: str | None) -> list[str]:
    """Pieces of a text between white space, which no word and no special token crosses; none for null.

    Pieces are in normal form, which makes them repeat more often, unless the
    text may hold a special token or would change if brought to normal form
    twice. Texts with control characters on which Python and Unicode disagree
    stay one piece.
    """
    if not text:
        return []
    if _odd_space.search(text):
        return [text]
    if "<|" not in text:
        normal = _normal(text)
        if normal.isascii() or unicodedata.is_normalized("NFC", normal):
            return normal.split()
    return text.split()


def words_of_chunks(pieces: list[str]) -> list[list[str]]:
    """Words of each piece. Plain pieces are joined and cut in one go."""
    plain = [p for p in pieces if "<|" not in p and not _odd_space.search(p)]
    far = [p for p in plain if _far.search(p)]
    near = plain if not far else [p for p in plain if not _far.search(p)]
    cut: dict[str, list[str]] = {}
    for group, limit in ((near, NEAR), (far, 0x110000)):
        if group:
            found = _find(limit)(_normal("\n".join(group)) + "\n")
            at = 0
            for p in group:
                end = found.index("\n", at)
                cut[p] = found[at:end]
                at = end + 1
    return [cut[p] if p in cut else words(p) for p in pieces]


@cache
def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where printable, else the next free code point from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [letters[b] for b in range(256)]


class Merges:
    """The merge table of a vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        self.token = {i: t for t, i in vocab.items()} | {i: t for t, i in SPECIAL.items()}
        self.inner = [vocab[x] for x in byte_letters()]
        self.last = [vocab[x + WORD_END] for x in byte_letters()]
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[vocab[a], vocab[b]] = (r, vocab[a + b])

        keys = np.array([a << 32 | b for a, b in self.rank], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.merged = keys[order], np.array([m for _, m in self.rank.values()], dtype=np.int64)[order]
        self.ranks = order  # the table lists pairs by rank

    def ids(self, word: str) -> list[int]:
        """Token ids of one word: the pair of lowest rank is merged first, the leftmost among equals."""
        return self.many([word])[0]

    def many(self, asked: list[str]) -> list[list[int]]:
        """Token ids of each word. Words of like length are merged together, one step at a time."""
        out: list[list[int]] = [[]] * len(asked)
        data = [w.encode() for w in asked]
        short = []
        for i, w in enumerate(asked):
            if w in SPECIAL:
                out[i] = [SPECIAL[w]]
            elif len(data[i]) > TOGETHER:
                d = data[i]
                out[i] = self._merge_long([*(self.inner[b] for b in d[:-1]), self.last[d[-1]]])
            else:
                short.append(i)
        short.sort(key=lambda i: len(data[i]))
        for at in range(0, len(short), 8192):
            part = short[at : at + 8192]
            for i, ids in zip(part, self._merge_together([data[i] for i in part])):
                out[i] = ids
        return out

    def _rank_of(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of the pairs; those that don't merge, or where a word has ended (-1), rank last."""
        key = a << 32 | np.where(b < 0, 0, b)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[at] == key) & (b >= 0) & (a >= 0)
        return np.where(hit, self.ranks[at], NEVER), np.where(hit, self.merged[at], -1)

    def _merge_together(self, data: list[bytes]) -> list[list[int]]:
        n, sizes = len(data), np.array(list(map(len, data)))
        width = int(sizes.max())
        filled = np.arange(width) < sizes[:, None]
        symbols = np.full((n, width + 1), -1, dtype=np.int64)
        flat = np.frombuffer(b"".join(data), dtype=np.uint8)
        symbols[:, :width][filled] = np.array(self.inner)[flat]
        symbols[np.arange(n), sizes - 1] = np.array(self.last)[flat[np.cumsum(sizes) - 1]]
        rank, merged = self._rank_of(symbols[:, :-1], symbols[:, 1:])
        rows, cols = np.arange(n), np.arange(width)
        done: list[list[int]] = [[]] * n
        while len(rows):
            best = rank.argmin(axis=1)
            going = rank[np.arange(len(rows)), best] < NEVER
            for i, r in zip(rows[~going].tolist(), symbols[~going].tolist()):
                done[i] = r[: r.index(-1)]
            rows, symbols, rank, merged, best = rows[going], symbols[going], rank[going], merged[going], best[going]
            k = np.arange(len(rows))
            symbols[k, best] = merged[k, best]
            after = cols + (cols > best[:, None])  # what stands right of the merged pair moves left
            symbols[:, :-1] = np.take_along_axis(symbols, after, axis=1)
            after = np.minimum(cols + (cols >= best[:, None]), width - 1)
            rank, merged = np.take_along_axis(rank, after, axis=1), np.take_along_axis(merged, after, axis=1)
            rank[:, -1] = NEVER
            for side in (best - 1, best):
                ok = side >= 0
                r, m = self._rank_of(symbols[k[ok], side[ok]], symbols[k[ok], side[ok] + 1])
                rank[k[ok], side[ok]], merged[k[ok], side[ok]] = r, m
        return done

    def _merge_long(self, out: list[int]) -> list[int]:
        """The same with a heap and links to the neighbours, for words of any length."""
        n = len(out)
        left, right, gone = list(range(-1, n - 1)), list(range(1, n + 1)), bytearray(n)
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and right[i] < n and (r := self.rank.get((out[i], out[right[i]]))):
                heapq.heappush(heap, (r[0], i, out[i], out[right[i]], r[1]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, a, b, merged = heapq.heappop(heap)
            if gone[i] or out[i] != a or right[i] >= n or out[j := right[i]] != b:
                continue
            out[i], gone[j], right[i] = merged, 1, right[j]
            if right[i] < n:
                left[right[i]] = i
            offer(left[i])
            offer(i)
        return [t for t, g in zip(out, gone) if not g]


@lru_cache(maxsize=2)
def merges(path: str) -> Merges:
    return Merges(path)


# --- the automaton -----------------------------------------------------------


def compile_lexicon(entries: Iterable[tuple[str, list[int]]]) -> bytes:
    """Minimal acyclic transducer of (word, ids) as one flat block of 32-bit integers.

    Words are added in byte order; as soon as a branch can no longer grow, its
    states are replaced by equal ones that exist already, so suffixes are
    shared. Each edge carries how many words come before it; the sum along a
    path is the word's place in the id lists.
    """
    items = sorted((w.encode(), ids) for w, ids in entries)
    known: dict[tuple, int] = {}
    states: list[tuple[bool, list[tuple[int, int]]]] = []  # (final, edges) of finished states
    path: list[list] = [[False, []]]  # open states along the last word: [final, edges]
    labels: list[int] = []

    def finish(node: list) -> int:
        key = (node[0], tuple(node[1]))
        at = known.get(key)
        if at is None:
            at = known[key] = len(states)
            states.append((node[0], node[1]))
        return at

    def close(depth: int) -> None:
        while len(path) > depth + 1:
            done = finish(path.pop())
            path[-1][1].append((labels.pop(), done))

    last = None
    for word, _ in items:
        if word == last:
            raise ValueError(f"repeated word {word!r}")
        common = 0
        while common < len(labels) and common < len(word) and labels[common] == word[common]:
            common += 1
        close(common)
        for b in word[common:]:
            labels.append(b)
            path.append([False, []])
        path[-1][0] = True
        last = word
    close(0)
    root = finish(path[0])

    reach: list[int] = []  # words below each state; targets are finished before their sources
    keys, targets, before = [], [], []
    for s, (final, edges) in enumerate(states):
        n = int(final)
        for b, t in edges:
            keys.append(s * 256 + b)
            targets.append(t)
            before.append(n)
            n += reach[t]
        reach.append(n)
    if len(states) * 256 >= 2**31:
        raise ValueError("the lexicon has too many states for 32-bit keys")
    order = np.argsort(np.array(keys, dtype=np.int64), kind="stable")
    put = lambda x: np.array(x, dtype=np.int32)
    offsets = np.cumsum([0, *(len(ids) for _, ids in items)])
    parts = [put(keys)[order], put(targets)[order], put(before)[order], put([f for f, _ in states]), put(offsets), put([i for _, ids in items for i in ids])]
    return put([root, len(parts), *map(len, parts)]).tobytes() + b"".join(x.tobytes() for x in parts)


class Lexicon:
    """A compiled lexicon, mapped from a file or taken from memory."""

    def __init__(self, data: str | bytes):
        flat = np.frombuffer(data, dtype=np.int32) if isinstance(data, bytes) else np.memmap(data, dtype=np.int32, mode="r")
        self.root, n = int(flat[0]), int(flat[1])
        parts, at = [], 2 + n
        for size in flat[2 : 2 + n]:
            parts.append(flat[at : at + int(size)])
            at += int(size)
        self.keys, self.targets, self.before, self.final, self.offsets, self.ids = parts

    def find(self, asked: list[str]) -> np.ndarray:
        """Each word's place in the lexicon, -1 if it is not there; all words walk together."""
        data = [w.encode() for w in asked]
        sizes = np.fromiter(map(len, data), dtype=np.int64, count=len(data))
        starts = np.cumsum(sizes) - sizes
        flat = np.frombuffer(b"".join(data), dtype=np.uint8).astype(np.int64)
        state = np.full(len(data), self.root, dtype=np.int64)
        place = np.zeros(len(data), dtype=np.int64)
        active = np.arange(len(data)) if len(self.keys) else np.zeros(0, dtype=np.int64)
        out = np.full(len(data), -1, dtype=np.int64)
        depth = 0
        while len(active):
            ended = sizes[active] == depth
            done = active[ended]
            done = done[self.final[state[done]] == 1]
            out[done] = place[done]
            active = active[~ended]
            key = state[active] * 256 + flat[starts[active] + depth]
            at = np.searchsorted(self.keys, key)
            at[at == len(self.keys)] = 0
            hit = self.keys[at] == key
            active, at = active[hit], at[hit]
            place[active] += self.before[at]
            state[active] = self.targets[at]
            depth += 1
        return out

    def ids_at(self, place: int) -> list[int]:
        return self.ids[self.offsets[place] : self.offsets[place + 1]].tolist()


@lru_cache(maxsize=2)
def _mapped(name: str) -> Lexicon:
    return Lexicon(SparkFiles.get(name))


class Encoder:
    """Encodes the pieces between white space and remembers recent ones.

    A new piece is cut into words; the lexicon gives the ids of the words it
    knows, the others are merged. ``form`` turns a piece's ids into what the
    caller wants to put together.
    """

    def __init__(self, ids_of: Callable[[list[str]], list[list[int]]], form: Callable[[list[int]], object]):
        self.ids_of, self.form = ids_of, form
        self.memo: dict[str, object] = {}

    def learn(self, new: set[str]) -> None:
        asked = list(new)
        self.memo.update(zip(asked, map(self.form, self.ids_of(asked))))

    def blocks(self, texts: Iterable[str | None]) -> Iterator[list[list]]:
        """For blocks of texts, the form of each text's pieces in order; null is the empty text."""
        block, size = [], 0
        for text in texts:
            block.append(chunks(text))
            size += len(text or "")
            if size >= BLOCK_CHARS:
                yield self._take(block)
                block, size = [], 0
        if block:
            yield self._take(block)

    def _take(self, block: list[list[str]]) -> list[list]:
        if len(self.memo) > MEMO_PIECES:
            self.memo.clear()
        get = self.memo.get
        out = [list(map(get, pieces)) for pieces in block]
        lacking = [(pieces, forms, [i for i, f in enumerate(forms) if f is None]) for pieces, forms in zip(block, out) if None in forms]
        if lacking:
            self.learn({pieces[i] for pieces, _, at in lacking for i in at})
            for pieces, forms, at in lacking:
                for i in at:
                    forms[i] = get(pieces[i])
        return out


def piece_ids(path: str, lexicon: Lexicon | None = None) -> Callable[[list[str]], list[list[int]]]:
    """Ids of pieces: words by the lexicon, if there is one, with exact merging of those that it lacks."""
    m = merges(path)
    merged: dict[str, list[int]] = {}

    def ids_of(pieces: list[str]) -> list[list[int]]:
        cut = words_of_chunks(pieces)
        new = list(set().union(*cut).difference(merged))
        if len(merged) + len(new) > MEMO_PIECES // 2:
            merged.clear()
            new = list(set().union(*cut))
        found, lacking = {}, new
        if lexicon:
            places = lexicon.find(new).tolist()
            found = {w: lexicon.ids_at(at) for w, at in zip(new, places) if at >= 0}
            lacking = [w for w, at in zip(new, places) if at < 0]
        merged.update(zip(lacking, m.many(lacking)))
        found = ChainMap(found, merged) if found else merged
        return [[i for w in ws for i in found[w]] for ws in cut]

    return ids_of


def piece_bytes(path: str) -> Callable[[list[str]], list[bytes]]:
    """Ids of pieces as unsigned little-endian 32-bit numbers, merged exactly.

    Remembered words are byte strings, which take a third of the memory of
    lists of numbers, and a piece that is one word is that word's byte string.
    """
    m = merges(path)
    merged: dict[str, bytes] = {}

    def bytes_of(pieces: list[str]) -> list[bytes]:
        cut = words_of_chunks(pieces)
        # A piece that is one word lends that word its string.
        cut = [[p] if len(ws) == 1 and ws[0] == p else ws for p, ws in zip(pieces, cut)]
        new = list({w for ws in cut for w in ws}.difference(merged))
        if len(merged) + len(new) > MEMO_PIECES // 2:
            merged.clear()
            new = list({w for ws in cut for w in ws})
        merged.update(zip(new, [struct.pack(f"<{len(ids)}I", *ids) for ids in m.many(new)]))
        return [merged[ws[0]] if len(ws) == 1 else b"".join([merged[w] for w in ws]) for ws in cut]

    return bytes_of


# --- Spark -------------------------------------------------------------------


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) over all whole texts. Tasks add up their own counts first."""

    def count(batches):
        gc.disable()  # many small lists and no cycles
        seen: Counter = Counter()

        def out():
            found: Counter = Counter()
            for ws, n in zip(words_of_chunks(list(seen)), seen.values()):
                for w in ws:
                    found[w] += n
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(found.keys()), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column(0):
                seen.update(chunks(text.as_py()))
                if len(seen) > FLUSH_PIECES:
                    yield out()
        yield out()

    return docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, most: int) -> DataFrame:
    """Words whose count is at least a bound: the lowest one that keeps at most ``most`` words.

    The bound comes from a histogram over steps of the logarithm, so nothing is
    ranked in one task.
    """
    level = F.floor(F.log2("n") * 16)
    rows = counts.groupBy(level.alias("level")).agg(F.count("*").alias("words")).collect()  # a few hundred at most
    total, bound = 0, None
    for r in sorted(rows, key=lambda r: -r["level"]):
        total += r["words"]
        if total > most:
            break
        bound = r["level"]
    return counts.where(level >= bound) if bound is not None else counts.limit(0)


def build_lexicon(docs: DataFrame, path: str, most: int = LEXICON_WORDS) -> str:
    """Compile the corpus' frequent words; the ``SparkFiles`` name of the automaton.

    Words that occur once are never frequent. The driver gets at most ``most``
    words with their ids, whatever the size of the corpus.
    """
    counts = materialize(count_words(docs).where("n > 1"))

    def encode(batches):
        m = merges(path)
        for batch in batches:
            found = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(m.many(found), pa.list_(pa.int32()))], ["word", "ids"])

    table = frequent_words(counts, most).select("word").mapInArrow(encode, "word string, ids array<int>").toArrow()
    entries = zip(table.column("word").to_pylist(), table.column("ids").to_pylist())
    return shared_file(docs.sparkSession, compile_lexicon(entries), ".lexicon")


def encode_documents(docs: DataFrame, path: str, most: int = LEXICON_WORDS) -> DataFrame:
    """``docs`` with a column ``ids`` (array of int): the token ids of the whole text; empty for null or empty text."""
    name = build_lexicon(docs, path, most)

    @F.pandas_udf("array<int>")
    def encode(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = Encoder(piece_ids(path, _mapped(name)), lambda ids: ids)
        gc.disable()  # many small lists and no cycles
        for s in series:
            yield pd.Series([[i for w in ws for i in w] for block in enc.blocks(s) for ws in block], dtype=object)

    return docs.withColumn("ids", encode("text"))


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the text that the ids stand for: tokens joined by one space, unknown ids left out, null as null."""

    @F.pandas_udf("string")
    def text(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        token = merges(path).token
        for s in series:
            yield pd.Series([None if x is None else " ".join(token[i] for i in x if i in token) for x in s], dtype=object)

    return df.withColumn(out, text(ids))


@lru_cache(maxsize=1)
def _digest_encoder(path: str, name: str) -> Encoder:
    """Kept by a worker from task to task."""
    token = merges(path).token
    return Encoder(piece_ids(path, _mapped(name)), lambda ids: (" ".join(map(str, ids)), " ".join([token[i] for i in ids])))


def encode_digests(docs: DataFrame, path: str, most: int = LEXICON_WORDS) -> DataFrame:
    """One row per document: ``doc_id``, ``n_tokens``, and digests of its ids and of their decoded text.

    Every row is kept: repeated rows repeat, a null ``doc_id`` stays null, null
    and empty texts have no tokens. Other columns are ignored. An empty table
    gives an empty result.
    """
    name = build_lexicon(docs, path, most)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        enc = _digest_encoder(path, name)
        gc.disable()  # many small lists and no cycles
        for s in series:
            rows = []
            for block in enc.blocks(s):
                for ws in block:
                    ws = [w for w in ws if w[0]]
                    ids = " ".join([w[0] for w in ws])
                    rows.append((
                        ids.count(" ") + 1 if ids else 0,
                        hashlib.sha256(ids.encode()).hexdigest(),
                        hashlib.sha256(" ".join([w[1] for w in ws]).encode()).hexdigest(),
                    ))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            gc.collect()

    return docs.select("doc_id", digests("text").alias("d")).select("doc_id", "d.n_tokens", "d.ids_sha256", "d.decoded_sha256")
