"""Collocations against brute force, and the trie that counts them."""

import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from checks.compare import _rows, oracle_connection
from leadfit.llm import collocations as c
from leadfit.llm.registry import ORACLES, op13_phrase_collocations

SMALL = "/root/testdata/sf0.01"


def plain_collocations(rows, least=10, share=50, top=2000):
    counts, total = {}, Counter()
    for text, lang in rows:
        f = counts.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            total["und" if lang is None else lang] += len(words)
            for n in (1, 2, 3):
                f.update(zip(*(words[k:] for k in range(n))))
    out = set()
    for lang, f in counts.items():
        found = []
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        longer = {}
        for q, x in candidates.items():
            if len(q) == 3:
                longer.setdefault(q[:2], []).append(x)
                longer.setdefault(q[1:], []).append(x)
        for p, a in candidates.items():
            inside = longer.get(p, [])
            if any(100 * x >= share * a for x in inside):
                continue
            score, k = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, total[lang], -s))
    return out


def found(df):
    return {tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()}


def corpus(seed=1):
    r = random.Random(seed)
    words = ["the", "of", "Ärger", "co-op", "New", "new", "york", "x\x1cy", "日本", "don't", *(f"w{k}" for k in range(25))]
    marks = [" "] * 12 + ["\t", "  ", ". ", ", ", "\n", "\r\n", "\x0b", "; ", "!"]
    rows = []
    for k in range(400):
        text = "".join(r.choice(words[: r.choice([4, 12, 35])]) + r.choice(marks) for _ in range(r.randint(0, 60)))
        rows.append((text + (" new york city" if k % 3 else ""), r.choice(["en", "en", "de", None, ""])))
    return rows + [(None, "en"), ("", None), (" \t\n..", "de"), ("The of " * 20_000, "en")] + [(rows[0][0], rows[0][1])] * 12


def table(spark, rows):
    return spark.createDataFrame([(k, *x, "w", 1, 2) for k, x in enumerate(rows)], "doc_id long, text string, lang string, phrase string, n int, rank int")


def test_trie_finds_its_phrases_and_no_others():
    r = np.random.default_rng(2)
    words = r.integers(1, 1 << 62, 400, dtype=np.int64).astype(np.uint64)
    rows = {tuple(words[(400 * r.random(n) ** 3).astype(int)].tolist()) + (0,) * (3 - n) for n in r.choice([1, 2, 3], 9000).tolist()}
    hashes = np.array(sorted(rows), np.uint64)
    sizes = (hashes > 0).sum(axis=1)
    trie = c.DoubleArrayTrie.of(hashes, sizes)
    every = np.concatenate([hashes, words[r.integers(0, 400, (5000, 3))]])
    state = np.zeros(len(every), np.int64)
    for size in (1, 2, 3):
        state = trie.step(state, trie.numbers(every[:, size - 1]))
        phrase = np.where(state >= 0, trie.phrase[state], -1)
        for row, p in zip(every.tolist(), phrase.tolist()):
            want = tuple(row[:size]) + (0,) * (3 - size)
            assert (p >= 0) == (want in rows and 0 not in row[:size])
            assert p < 0 or tuple(hashes[p].tolist()) == want
    assert c.DoubleArrayTrie.of(hashes[:0], sizes[:0]).step(np.zeros(1, np.int64), np.array([-1])).tolist() == [-1]


def test_collocations_as_brute_force(spark):
    rows = corpus()
    assert found(c.collocations(table(spark, rows))) == plain_collocations(rows)


def test_many_small_portions_tries_and_flushes(spark, monkeypatch):
    """Bounds of portions, tasks and tries change nothing."""
    for name, value in (("BYTES_AT_ONCE", 400), ("ENTRIES_AT_ONCE", 50), ("PHRASES_OF_A_BUCKET", 500), ("PHRASES_OF_A_TRIE", 60), ("BLOCK_BITS", 4), ("FILTER_BITS", 16)):
        monkeypatch.setattr(c, name, value)
    rows = corpus(3)[:200]
    assert found(c.collocations(table(spark, rows).repartition(5))) == plain_collocations(rows)
    assert found(c.collocations(table(spark, rows), least=4, share=80, top=7)) == plain_collocations(rows, 4, 80, 7)


def test_wide_dictionaries(spark):
    """A portion with more distinct words than two bytes tell apart."""
    rows = [(" ".join(f"v{k}" for k in range(70_000)) + " . " + "far away " * 11, "en")]
    assert found(c.collocations(table(spark, rows))) == plain_collocations(rows)


@pytest.mark.parametrize("rows", [[], [(None, None)], [("one two three", "en")]])
def test_nothing_to_find(spark, rows):
    assert found(c.collocations(table(spark, rows))) == set()


def test_scores_beyond_64_bits(spark):
    """1000000 * a * a and l * r need more than 64 bits here."""
    cases = [(10**13, 2 * 10**13, 3 * 10**13), (999_999_999_999, 10**12, 999_999_999_999), (10, 10, 10), (3_037_000_500, 3_037_000_501, 9_000_000_000)]
    df = spark.createDataFrame(cases, "a long, l long, r long")
    got = [r[0] for r in df.select(c.cut_score(df["a"], df["l"], df["r"])).collect()]
    assert got == [10**6 * a * a // (x * y) for a, x, y in cases]


def test_query_as_sql_and_brute_force(spark):
    con = oracle_connection(SMALL)
    got = op13_phrase_collocations(spark, SMALL)
    rel = con.execute(ORACLES["op13_phrase_collocations"])
    assert _rows(got.columns, got.collect()) == _rows([d[0] for d in rel.description], rel.fetchall())
    docs = con.execute("SELECT text, lang FROM documents").fetchall()
    assert found(got) == plain_collocations(docs)


def test_memory_of_a_full_bucket():
    """Two tasks of an executor add up a bucket each; what that takes beside the JVM must stay small, whatever the corpus."""
    random_hashes = np.random.default_rng(1).integers(0, 1 << 63, (3, c.PHRASES_OF_A_BUCKET), np.uint64)
    blocks = np.array_split(np.arange(c.PHRASES_OF_A_BUCKET), 8)
    table = pa.table({
        "hashes": [random_hashes[:, b].tobytes() for b in blocks], "counts": [np.full(len(b), 10, np.uint8).tobytes() for b in blocks]})
    tracemalloc.start()
    out = c.met(table, 3, 10)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.num_rows == c.PHRASES_OF_A_BUCKET
    assert peak < 100e6


def test_broadcasts_go_as_soon_as_they_are_used(spark, monkeypatch):
    """Tries and bitmaps of earlier passes stay on no executor."""
    sent, send = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append(send(self, value)) or sent[-1])
    docs = spark.createDataFrame([(1, "to be or not to be. " * 20, "en")], "doc_id long, text string, lang string")
    assert c.collocations(docs).count() > 0
    assert len(sent) >= 4 and not any(b._jbroadcast.isValid() for b in sent)
