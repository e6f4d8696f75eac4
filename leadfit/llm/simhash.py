"""Near-duplicate documents by simhash fingerprints that meet in the codewords of the binary Golay code.

The code has 4096 codewords of 23 bits, and every word of 23 bits lies within 3 bits of exactly one of them. A word that
lies at 3 bits has five further codewords at 4. Two words that differ in at most 2 bits always share one of the codewords
within 4 bits of each (by the Steiner system of the code's words of weight 7), and if they differ in at most 1 bit, the
nearest codeword of either is among those of the other.

A fingerprint of 64 bits is cut into three segments of 22, 21 and 21 bits, each padded to a word of the code. Four bits
that differ leave at most one bit in each of two segments, or two bits in two segments and none in the third:

- at most one in each of two: the pair of codeword indices (nearest of the one segment, any of the other) of one
  fingerprint equals (any, nearest) of the other; 24 bits of key
- two, two and none: equal bits of the third segment and a common index of the segment behind it; 33 bits of key or more

Fingerprints that share a key are compared bit by bit inside a task, which passes on only links that join what it has
not joined yet.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadfit.llm.bpe import ragged
from leadfit.llm.common import texts_of, written
from leadfit.llm.neardup import components

SEED = 42
GENERATOR = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
SEGMENTS = ((42, 22), (21, 21), (0, 21))  # lowest bit and width
PAIRS = ((0, 1), (1, 2), (2, 0))
MOST = 4  # differing bits of linked fingerprints
HOT = 16_384  # rows of one key that are compared in one task; the fingerprints of larger keys meet by their neighbours
ROWS_AT_ONCE = 512  # texts whose fingerprints are made together
SHINGLES_AT_ONCE = 1 << 15
KEYS_AT_ONCE = 1 << 17  # key rows that are compared together
PAIRS_AT_ONCE = 1 << 21

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None, words: int = 4) -> int:
    """Bit j is set where over half of the hashes of the text's shingles have it set; 0 for a text without words.

    Words are runs without ASCII white space, A-Z in lower case; shingles of `words` words count as often as they stand,
    and fewer words are one shingle. The hash is XXH64 of a shingle's words joined by blanks.
    """
    parts = (text or "").encode().translate(_LOWER).split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    size = min(words, len(parts))
    length = np.fromiter(map(len, parts), np.int64, len(parts))
    end = np.cumsum(length + 1) - 1
    start, end = (end - length)[:len(parts) - size + 1].tolist(), end[size - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    set_ = np.zeros(64, np.int64)
    for i in range(0, len(start), SHINGLES_AT_ONCE):
        hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(start[i:i + SHINGLES_AT_ONCE], end[i:i + SHINGLES_AT_ONCE])], ">u8")
        set_ += np.unpackbits(hashes.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.uint16)
    return int.from_bytes(np.packbits(2 * set_ > len(start)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS_AT_ONCE):
                rows = batch.slice(i, ROWS_AT_ONCE)
                fp = np.fromiter((fingerprint(t.as_py(), words) for t in rows.column("text")), np.uint64, rows.num_rows)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return texts_of(docs).mapInArrow(run, "doc_id long, fp long")


@lru_cache(maxsize=1)
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the lower 12 and of the upper 11 bits of a word, and for each remainder of a word the differences
    (six at most, -1 where there are fewer) from the word to the codewords within 4 bits, the nearest first."""
    unit = [1]
    for _ in range(22):
        x = unit[-1] << 1
        unit.append(x ^ GENERATOR if x >> 11 else x)
    tables = []
    for bits in (unit[:12], unit[12:]):
        t = np.zeros(1, np.int64)
        for u in bits:
            t = np.concatenate([t, t ^ u])
        tables.append(t)
    near = np.full((2048, 6), -1, np.int64)
    filled = np.zeros(2048, np.int64)
    for weight in range(5):
        for places in combinations(range(23), weight):
            remainder = 0
            for p in places:
                remainder ^= unit[p]
            near[remainder, filled[remainder]] = sum(1 << p for p in places)
            filled[remainder] += 1
    return tables[0], tables[1], near


def codewords(segment: np.ndarray) -> np.ndarray:
    """Indices (from 0 to 4095) of the codewords within 4 bits of each word, the nearest first; -1 where there are fewer."""
    low, high, near = golay()
    difference = near[low[segment & 4095] ^ high[segment >> 12]]
    # the upper 12 bits of a codeword tell which one it is
    return np.where(difference >= 0, (segment[:, None] ^ difference) >> 11, -1)


def meeting_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, side) of fingerprints: two that differ in at most MOST bits share a key, with sides 0 and 1 or both 2."""
    raw = [((fp >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
    near = [codewords(x << (23 - width)) for x, (_, width) in zip(raw, SEGMENTS)]
    row, key, side = [], [], []

    def add(kind: int, keys: np.ndarray, valid: np.ndarray, role: int) -> None:
        r, c = np.nonzero(valid)
        row.append(r)
        key.append(keys[r, c] | (kind << 60))
        side.append(np.full(len(r), role, np.int8))

    for kind, (i, j) in enumerate(PAIRS):
        add(kind, near[i][:, :1] << 12 | near[j], near[j] >= 0, 0)
        add(kind, near[i] << 12 | near[j][:, :1], near[i] >= 0, 1)
    for c in range(3):
        other = near[(c + 1) % 3]
        add(3 + c, raw[c][:, None] << 12 | other, other >= 0, 2)
    return np.concatenate(row), np.concatenate(key), np.concatenate(side)


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, root) that join the same values as the links a - b, one for each value but the roots."""
    value, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[:len(a)], place[len(a):]
    label = np.arange(len(value))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new[label], label):
            break
        label = new[label]
    other = np.flatnonzero(label != np.arange(len(value)))
    return value[other], value[label[other]]


def linked_within(key: np.ndarray, side: np.ndarray, fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links between fingerprints of whole keys, sorted by key and side, a bounded number of pairs at a time."""
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[first, len(key)])
    lefts = np.add.reduceat(side == 0, first)
    both = side[first] == 2
    group = np.repeat(np.arange(len(first)), size)
    # each row of side 0 meets those of side 1, each row of side 2 those behind it
    left = np.flatnonzero(side != 1)
    begin = np.where(both[group[left]], left + 1, (first + lefts)[group[left]])
    count = (first + size)[group[left]] - begin
    total = np.cumsum(count)
    at = 0
    while at < len(left):
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
        x = np.repeat(left[at:stop], count[at:stop])
        y = ragged(begin[at:stop], count[at:stop])
        near = (np.bitwise_count(fp[x] ^ fp[y]) <= MOST) & (fp[x] != fp[y])
        if near.any():
            yield roots(fp[x[near]], fp[y[near]])
        at = stop


def _links(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for a, b in pairs:
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])


def links_of_keys(keys: DataFrame) -> DataFrame:
    """(a, b) of keys (key, side, fp) none of which has more than HOT rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros(0, np.int8), np.zeros(0, np.uint64)]
        waiting: list[list[np.ndarray]] = []
        rows = 0

        def whole(last: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            nonlocal held, waiting, rows
            key, side, fp = (np.concatenate(x) for x in zip(held, *waiting))
            stop = len(key) if last or not len(key) else int(np.searchsorted(key, key[-1]))
            held, waiting, rows = [key[stop:], side[stop:], fp[stop:]], [], 0
            if stop:
                yield from linked_within(key[:stop], side[:stop], fp[:stop])

        for batch in batches:
            waiting.append([batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64)])
            rows += batch.num_rows
            if rows >= KEYS_AT_ONCE:
                yield from _links(whole(False))
        yield from _links(whole(True))

    return keys.select("key", "side", "fp").repartition("key").sortWithinPartitions("key", "side").mapInArrow(run, "a long, b long")


def links_by_neighbours(fps: DataFrame) -> DataFrame:
    """(a, b) of distinct fingerprints (fp), for any number that lie close together.

    Two fingerprints differ in at most 4 bits exactly if some value differs in at most 2 bits from each. So each goes to
    the 2,081 values around it, and those that meet there are linked as a chain: rows in proportion to the fingerprints.
    """
    one = [1 << i for i in range(64)]
    around = np.array([0, *one, *(x | y for x, y in combinations(one, 2))], np.uint64)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            for i in range(0, len(fp), 64):
                part = fp[i:i + 64]
                value = (part[:, None] ^ around).reshape(-1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(value.view(np.int64)), pa.array(np.repeat(part, len(around)).view(np.int64))], ["value", "fp"])

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            value = np.concatenate([value[-1:], batch.column("value").to_numpy()])
            fp = np.concatenate([fp[-1:], batch.column("fp").to_numpy().view(np.uint64)])
            same = value[1:] == value[:-1]
            if same.any():
                yield from _links([roots(fp[:-1][same], fp[1:][same])])

    met = fps.select("fp").mapInArrow(spread, "value long, fp long")
    return met.repartition("value").sortWithinPartitions("value").mapInArrow(chained, "a long, b long")


def links_of(nodes: DataFrame) -> DataFrame:
    """Links (a, b) that join all distinct fingerprints (fp) that differ in at most MOST bits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            row, key, side = meeting_keys(fp)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(side), pa.array(fp[row].view(np.int64))], ["key", "side", "fp"])

    keys = written(nodes.select("fp").mapInArrow(run, "key long, side byte, fp long"), "keys")
    hot = written(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select("key"), "hot")
    if hot.isEmpty():
        return links_of_keys(keys)
    crowded = written(keys.join(hot, "key", "left_semi").select("fp").distinct(), "crowded")
    return links_of_keys(keys.join(hot, "key", "left_anti")).union(links_by_neighbours(crowded))


def fuzzy_duplicates(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of docs.

    Fingerprints link where they differ in at most MOST bits; component_id is the smallest doc_id that links lead to, the
    document itself included. No link is missed: equal fingerprints are one node, and the keys find every other link.

    A null or empty text, or one without words, has the fingerprint zero and is linked like any other. A row without
    doc_id has its fingerprint and a null component, and joins nothing. Rows that repeat an id each have their own
    fingerprint; the component of each is that of its fingerprint. An empty table gives an empty one; other columns are
    ignored.
    """
    sig = written(fingerprints(docs, words), "fingerprints")
    nodes = written(sig.where(F.col("doc_id").isNotNull()).groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    links = written(links_of(nodes), "links")
    labels = components(links).withColumnRenamed("node", "fp")
    named = nodes.join(labels, "fp").select("fp", "label", "rep")
    smallest = named.groupBy("label").agg(F.min("rep").alias("least"))
    found = named.join(smallest, "label").select("fp", "least")
    own = nodes.join(found, "fp", "left").select("fp", F.coalesce("least", "rep").alias("component_id"))
    shown = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    with_id = sig.where(F.col("doc_id").isNotNull()).join(own, "fp").select("doc_id", shown, "component_id")
    return with_id.union(sig.where(F.col("doc_id").isNull()).select("doc_id", shown, F.lit(None).cast("long").alias("component_id")))
