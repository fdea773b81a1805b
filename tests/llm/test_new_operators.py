"""Mixture packing, periodic runs and collocations against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from eraloom.llm import collocations, mixture_packing, periodic
from eraloom.llm.common import tokenizer_path

BYTES = "byte_bpe_50k.json"
# Columns beside the documents' own have names that the operators use themselves.
DOCS = (
    "doc_id long, text string, lang string, source string, n_chars long, ids string, n int, part int, at int, queue int, base int, start int, length int, "
    "rank int, phrase string, word string, bucket int, d int, score double"
)


def docs(spark, rows):
    """Documents from (doc_id, text[, lang[, source]])."""
    full = [(*r, *[None] * (4 - len(r))) for r in rows]
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), "x", 7, 7, 7, 7, 7, 7, 7, 7, "x", "x", 7, 7, 0.5) for i, t, lang, s in full], DOCS)


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(BYTES))


# --- mixture packing ----------------------------------------------------------

ODD = ["", None, "a<|endoftext|>b", " " * 30 + "x", "\n\n \t tab\x1c\x85\xa0 it's WE'LL 12 日本語 \U0001f600!!", "x" * 5000, "ab " * 3000]


def test_ids_are_those_of_the_library():
    ids_of, size = mixture_packing.encoder(tokenizer_path(BYTES))
    t, rng = library(), random.Random(4)
    letters = "abcdeABC  \n\t\x0b\xa0　'sré日1.,!<|>\U0001f600"
    texts = [x for x in ODD if x] + ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 60))) for _ in range(3000)]
    texts += ["".join(chr(c) for c in range(a, a + 500) if not 0xD800 <= c < 0xE000) for a in range(0, 0x30000, 500)]
    texts.append(" " * 1_500_000 + "end")  # the quick way gives up here
    for x, want in zip(texts, t.encode_batch(texts, add_special_tokens=False)):
        assert ids_of(x).tolist() == want.ids, repr(x[:80])
    assert size == 50257


def test_word_vocabularies_go_through_the_library():
    ids_of, _ = mixture_packing.encoder(tokenizer_path("word_bpe_49k.json"))
    from tokenizers import Tokenizer

    assert ids_of("Hello, World").tolist() == Tokenizer.from_file(tokenizer_path("word_bpe_49k.json")).encode("Hello, World", add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(30))
def test_schedule_never_takes_back_and_keeps_to_the_shares(seed):
    rng = random.Random(seed)
    m = rng.randint(1, 6)
    tokens = [rng.choice([0, 1, 2, 5, 50, 3000, rng.randint(1, 10_000)]) for _ in range(m)]
    own = rng.random() < 0.5
    shares = tokens if own else [rng.choice([0, 1, 3, 10]) for _ in range(m)]
    s = mixture_packing.Schedule(tokens, shares)
    before = (0,) * m
    for t in sorted({*range(min(s.total, 300)), *range(0, s.total + 1, 97), s.total}):
        now = s.served(t)
        assert sum(now) == t and all(a <= b for a, b in zip(before, now))
        if own and s.total:
            assert all(abs(x - t * n / s.total) <= max(1, m / 2) for x, n in zip(now, tokens))
        before = now
    assert before == tuple(tokens)


def test_schedule_follows_targets_until_a_queue_ends():
    s = mixture_packing.Schedule([1000, 300, 50], [1, 3, 0])
    assert s.served(400) == (100, 300, 0) and s.served(1300) == (1000, 300, 0) and s.served(1350) == (1000, 300, 50)


def test_very_large_counts_stay_exact():
    tokens = [10**13 + 7, 3 * 10**12 + 1, 5, 10**9]
    s = mixture_packing.Schedule(tokens, tokens)
    for t in (1, 1024, 10**12 + 3, s.total - 1):
        a, b = s.served(t), s.served(t + 1)
        assert sum(a) == t and sum(b) == t + 1 and all(x <= y for x, y in zip(a, b))


def check_packing(rows, given, window):
    ids = [np.array((library().encode(t, add_special_tokens=False).ids if t else []) + [0], dtype="<u4") for t in given]
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, x in enumerate(ids):
        at = 0
        for r in sorted(pieces.pop(i), key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(x) and r["ids_crc32"] == zlib.crc32(x[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(x)
    assert not pieces
    full = sum(map(len, ids)) // window
    for k, parts in sequences.items():
        end = 0
        for at, length in sorted(parts):
            assert at == end
            end += length
        assert end == window or (k >= full and end & (end - 1) == 0)


@pytest.mark.parametrize("targets", [None, {"a": 3, "b": 1}, {None: 1, "c": 0}])
def test_mixture_packing_places_each_id_once(spark, targets):
    rng = random.Random(2)
    given = ODD + [" ".join(rng.choice(["river", "stone", "light"]) + str(rng.randrange(99)) for _ in range(rng.randrange(300))) for _ in range(60)]
    table = docs(spark, [(i, t, None, rng.choice(["a", "a", "b", None, "c"])) for i, t in enumerate(given)]).repartition(5)
    rows = mixture_packing.pack_documents(table, tokenizer_path(BYTES), targets, window=256).collect()
    check_packing(rows, given, 256)
    if targets is None:
        sizes = Counter()
        for r in rows:
            sizes[r["source"]] += r["length"]
        total = sum(sizes.values())
        by = Counter()
        for r in rows:
            by[r["sequence_id"], r["source"]] += r["length"]
        for k in range(total // 256):
            for s, n in sizes.items():
                assert abs(by[k, s] - 256 * n / total) < 3


def test_more_sources_than_queues_share_the_last(spark, monkeypatch):
    monkeypatch.setattr(mixture_packing, "QUEUES", 3)
    given = [f"word {i} " * (i + 1) for i in range(20)]
    rows = mixture_packing.pack_documents(docs(spark, [(i, t, None, f"s{i % 7}") for i, t in enumerate(given)]), tokenizer_path(BYTES), window=64).collect()
    check_packing(rows, given, 64)


def test_mixture_packing_of_nothing_repeats_and_null_ids(spark):
    assert mixture_packing.pack_documents(docs(spark, []), tokenizer_path(BYTES)).count() == 0
    rows = mixture_packing.pack_documents(docs(spark, [(None, "x y"), (5, "x y"), (5, "x y")]), tokenizer_path(BYTES)).collect()
    assert Counter(r["doc_id"] for r in rows for _ in range(r["length"])) == {None: 3, 5: 6}


# --- periodic runs ------------------------------------------------------------


def brute_runs(w):
    n, best = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                best.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in best.items()), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("seed", range(40))
def test_runs_match_brute_force(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(20):
        n, k = rng.choice([0, 1, 3, 6, 10, 30, 80]), rng.choice([1, 2, 2, 3, 5])
        w = [rng.randrange(k) for _ in range(n)]
        for _ in range(rng.randint(0, 3)):
            if n:
                a, unit = rng.randrange(n), [rng.randrange(k) for _ in range(rng.randint(1, 6))]
                w[a:] = ((unit * 8)[: n - a] + w[a + 8 * len(unit) :])[: n - a]
        texts.append(w)
    assert periodic.runs_of_block(texts) == [brute_runs(t) for t in texts]


def test_long_runs_take_no_square_time():
    assert periodic.runs_of_block([[0] * 150_000, list(range(7)) * 20_000, list(range(50_000))]) == [[(0, 150_000, 1)], [(0, 140_000, 7)], []]


def digest(words, runs):
    keep = [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs)]
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    return (
        len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
        hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(), hashlib.sha256(" ".join(keep).encode()).hexdigest(),
    )


def test_run_digests_follow_the_contract(spark):
    rng = random.Random(8)
    given = {i: " \t".join(rng.choice("ab") for _ in range(rng.randrange(60))) for i in range(300)}
    given |= {300: None, 301: "", 302: "\x0b\n", 303: "x y z " * 6000, 304: "é\xa0b é\xa0b é\xa0b é\xa0b é\xa0b é\xa0b", 305: "same " * 5 + "end"}
    got = {r["doc_id"]: tuple(r)[1:] for r in periodic.find(docs(spark, list(given.items())), tails=True).collect()}
    planted = 0
    for i, t in given.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        h, n = zlib.crc32(str(i).encode()), len(words)
        if h % 10 == 0 and n:
            planted += 1
            a, g = (h // 10) % n, h // 10
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (j - a) % p] for j in range(a, n)]
        runs = brute_runs(words) if n < 500 else [(0, n, 3)] if h % 10 else got[i] and periodic.runs_of_block([[ord(w[0]) for w in words]])[0]
        assert got[i] == digest(words, runs), i
    assert planted > 10 and list(got[300])[:5] == [0, None, None, None, None]


def test_runs_and_collapse_as_columns(spark):
    table = docs(spark, [(1, "go a b a b a b a b a stop"), (2, None), (3, "no run here"), (3, "no run here"), (None, "z " * 9)])
    rows = sorted(tuple(r) for r in periodic.find_rows(table.where("doc_id is not null")).collect())
    assert rows == [(1, 1, 9, 2)]
    out = table.select("doc_id", periodic.collapse("text").alias("t")).collect()
    assert sorted((str(r["doc_id"]), r["t"]) for r in out) == [("1", "go a b stop"), ("2", None), ("3", "no run here"), ("3", "no run here"), ("None", "z")]
    assert periodic.find(docs(spark, [])).count() == 0 and periodic.find(table).count() == 5


# --- collocations -------------------------------------------------------------


def brute_phrases(rows, least, share, top):
    f, n, out = {}, Counter(), []
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in (1, 2, 3):
                for i in range(len(ws) - k + 1):
                    f.setdefault(lang, Counter())[tuple(ws[i : i + k])] += 1
    for lang, c in f.items():
        found = {g: a for g, a in c.items() if len(g) > 1 and a >= least}
        held = Counter()
        for g, a in found.items():
            if len(g) == 3:
                for s in (g[:2], g[1:]):
                    held[s] = max(held[s], a)
        scored = []
        for g, a in found.items():
            if len(g) == 2 and g in held and 100 * held[g] >= share * a:
                continue
            score, k = min((1_000_000 * a * a // (c[g[:k]] * c[g[k:]]), k) for k in range(1, len(g)))
            scored.append((-score, -a, " ".join(g).encode(), c[g[:k]], c[g[k:]]))
        for rank, (s, a, g, l, r) in enumerate(sorted(scored)[:top], 1):  # noqa: E741
            out.append((lang, rank, g.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


@pytest.mark.parametrize("hot, bucket, chunk", [(1000, 3_000_000, 1_500_000), (4, 300, 200), (12, 1000, 10**6)])
def test_collocations_match_brute_force(spark, monkeypatch, hot, bucket, chunk):
    """Also with many hot words, buckets and chunks."""
    monkeypatch.setattr(collocations, "HOT", hot)
    monkeypatch.setattr(collocations, "BUCKET_WORDS", bucket)
    monkeypatch.setattr(collocations, "CHUNK_WORDS", chunk)
    rng = random.Random(hot)
    words = ["The", "the", "of", "city", "é", "new", "york", "a\xa0b", "x"] + [f"w{i}" for i in range(12)]
    weight = [30, 30, 20, 5, 3, 4, 4, 2, 2] + [1] * 12
    rows = []
    for i in range(150):
        ws = [w + rng.choice([" ", "  ", "\t", " ", " ", ". ", "\n", "!"]) for w in rng.choices(words, weight, k=rng.randrange(40))]
        rows.append(("".join(ws), rng.choice(["en", "de", None])))
    rows += [("new york city " * 12, "en"), ("the the the the " * 20, "en"), (None, "en"), ("", None), ("only one", "fr"), ("a b c " * 9, "fr")]
    table = docs(spark, [(i % 40, *r) for i, r in enumerate(rows)]).repartition(4)
    for least, share, top in ((10, 50, 2000), (3, 80, 7)):
        got = sorted(tuple(r) for r in collocations.mine(table, least, share, top).collect())
        assert got == brute_phrases(rows, least, share, top)


def test_collocations_of_nothing(spark):
    assert collocations.mine(docs(spark, [])).count() == 0
    assert collocations.mine(docs(spark, [(1, None), (None, " . ! ")])).count() == 0


def test_suffixes_of_many_words_fall_back_to_a_plain_sort(monkeypatch):
    chunk = collocations.Chunk()
    for i in range(30):
        chunk.add(f"l{i % 3}", "a b c a b c d. a b")
    packed = {tuple(x) for x in zip(*(c.tolist() for c in chunk.suffixes()))}
    monkeypatch.setattr(collocations._Numbers, "__len__", lambda self: 2**40, raising=False)
    assert {tuple(x) for x in zip(*(c.tolist() for c in chunk.suffixes()))} == packed


def test_quicksort_counts_equal_ranges():
    rng = np.random.default_rng(1)
    keys, weights = rng.integers(0, 6, (3, 5000)), rng.integers(1, 4, 5000)
    want = {}
    for d in (1, 2, 3):
        c = Counter()
        for g, w in zip(zip(*keys[:d].tolist()), weights.tolist()):
            c[g] += w
        want |= {g: n for g, n in c.items() if n >= 40}
    got = {}
    for d, heads, (members, first) in collocations.frequent(keys, weights, 40):
        for h, n in zip(heads, np.add.reduceat(weights[members], first)):
            got[tuple(keys[:d, h].tolist())] = n
    assert got == want
