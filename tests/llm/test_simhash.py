"""Simhash fingerprints and their Golay keys against brute force."""

import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash

from leadfit.llm import simhash
from leadfit.llm.registry import op11_simhash_near_dedup

SMALL = "/root/testdata/sf0.01"


def plain_fingerprint(text, size=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    n = min(size, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + n]).encode(), 42) for i in range(len(words) - n + 1)] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    """fps: (doc_id, fingerprint) with ids; the smallest id that links lead to, for each fingerprint."""
    parent = {f: f for _, f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    values = np.array(sorted(parent), np.uint64)
    for k, x in enumerate(values.tolist()):
        for y in values[k + 1:][np.bitwise_count(values[k + 1:] ^ np.uint64(x)) <= 4].tolist():
            parent[find(x)] = find(y)
    least = {}
    for i, f in fps:
        r = find(f)
        least[r] = min(i, least.get(r, i))
    return {f: least[find(f)] for f in parent}


def test_every_word_has_its_codewords():
    x = np.arange(1 << 23, dtype=np.int64)[:: 997]
    found = simhash.codewords(x)
    assert ((found >= 0).sum(axis=1) >= 1).all() and set((found >= 0).sum(axis=1).tolist()) == {1, 6}
    # a word and all words that differ in two bits share an index, and in one bit the nearest of either is among the other's
    r = random.Random(3)
    for word in r.sample(range(1 << 23), 60):
        mine = set(simhash.codewords(np.array([word]))[0].tolist()) - {-1}
        for places in combinations(range(23), 2):
            other = word ^ sum(1 << p for p in places)
            assert mine & set(simhash.codewords(np.array([other]))[0].tolist())
        near = simhash.codewords(np.array([word]))[0, 0]
        assert all(near in simhash.codewords(np.array([word ^ (1 << p)]))[0] for p in range(23))


def test_keys_of_all_linked_fingerprints_meet():
    r = np.random.default_rng(5)
    x = r.integers(0, 1 << 63, 4000, dtype=np.uint64) * np.uint64(2) + r.integers(0, 2, 4000, dtype=np.uint64)
    y = x.copy()
    for i in range(len(y)):
        for b in r.choice(64, r.integers(1, 5), replace=False):
            y[i] ^= np.uint64(1) << np.uint64(b)
    keys = []
    for turn, fp in enumerate((x, y)):
        row, key, side = simhash.meeting_keys(fp)
        side = side if not turn else np.where(side == 2, 2, 1 - side)
        keys.append(set(zip(row.tolist(), key.tolist(), side.tolist())))
    assert {i for i, _, _ in keys[0] & keys[1]} == set(range(len(x)))


@pytest.mark.parametrize("hot", [simhash.HOT, 40])
def test_links_join_as_brute_force(spark, monkeypatch, hot):
    """Crowds of near fingerprints, chains over the limit, and unlike ones; also where large keys go another way."""
    monkeypatch.setattr(simhash, "HOT", hot)
    r = random.Random(11)
    fps = {r.getrandbits(64) for _ in range(300)}
    for _ in range(4):
        base = r.getrandbits(64)
        for _ in range(60):
            fps.add(base ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 3))))
        for _ in range(15):  # a chain that wanders off
            base ^= sum(1 << b for b in r.sample(range(64), r.randint(3, 6)))
            fps.add(base)
    rows = [(int(np.uint64(f).astype(np.int64)),) for f in fps]
    links = simhash.links_of(spark.createDataFrame(rows, "fp long")).collect()
    want = plain_components([(k, f) for k, f in enumerate(sorted(fps))])
    a = np.array([r["a"] for r in links]).view(np.uint64).tolist()
    b = np.array([r["b"] for r in links]).view(np.uint64).tolist()
    got = {f: f for f in fps}

    def find(v):
        while got[v] != v:
            v = got[v]
        return v

    for v, w in zip(a, b):
        got[find(v)] = find(w)
    groups = {}
    for f in fps:
        groups.setdefault(find(f), set()).add(f)
    others = {}
    for f, c in want.items():
        others.setdefault(c, set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, others.values()))


def test_query_as_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    fps = [(r["doc_id"], plain_fingerprint(r["text"])) for r in docs]
    least = plain_components(fps)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in op11_simhash_near_dedup(spark, SMALL).collect()}
    assert got == {i: (f"{f:016x}", least[f]) for i, f in fps}
    assert len(set(least.values())) < len(fps)


def test_odd_documents(spark, odd, nothing):
    got = simhash.fuzzy_duplicates(odd).collect()
    assert len(got) == odd.count()
    fps = [(r["doc_id"], plain_fingerprint(r["text"])) for r in odd.collect()]
    least = plain_components([x for x in fps if x[0] is not None])
    want = sorted(((i, f"{f:016x}", least[f] if i is not None else None) for i, f in fps), key=repr)
    assert sorted((tuple(r) for r in got), key=repr) == want
    assert all(r["component_id"] == 2 and r["fingerprint"] == "0" * 16 for r in got if r["doc_id"] in (2, 3, 4))
    assert simhash.fuzzy_duplicates(nothing).count() == 0
