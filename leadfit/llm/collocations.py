"""Collocations: phrases of two or three words that stand together more often than their parts suggest.

Candidates grow level by level (Apriori): a pair can only be frequent if both its words are, a triple only if both its
pairs are. Frequent parts of one level are kept for the next as a bitmap of fixed size, which may let a rare one pass but
loses none; what passes is added up over the tasks as counts that stop at the threshold.

What is left is counted exactly. Words, pairs and triples go into double-array tries, a bounded number of phrases in
each; a trie is broadcast, and numpy moves the states of all positions of a portion of text through it at once, level by
level, counts the accepting states they reach, and sends the sums of its task on to be added up.

A word is the two digits of its number in the trie, so a node has a small alphabet and its children lie dense.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadfit.llm.bpe import ragged
from leadfit.llm.common import written
from leadfit.llm.neardup import combined

LEAST = 10  # occurrences of a candidate
SHARE = 50  # percent of a candidate's occurrences inside a longer one, from which on it is dropped
TOP = 2000  # phrases of a language that are returned
BYTES_AT_ONCE = 1 << 20  # text of a portion; a longer text is a portion of its own
GROUP_BYTES = 4 << 20  # portions that a reading task holds at once
ENTRIES_AT_ONCE = 1 << 18  # distinct phrases that a task holds before it sends them on
PHRASES_OF_A_BUCKET = 1 << 19  # occurrences for each bucket of phrases that are added up together
PHRASES_OF_A_TRIE = 1 << 18  # bound of a broadcast trie
FILTER_BITS = 26  # size of the bitmaps of frequent parts, 8 MB, whatever the corpus
BLOCK_BITS = 12  # phrases whose sums are added up together
SALTS = 32

_BORDER = np.zeros(256, bool)
_BORDER[[*b".,;:!?\x0a\x0b\x0c\x0d"]] = True
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
_PLAIN[_BORDER] = 32
_PLAIN[9] = 32


def tokens(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """Distinct words of texts, and the texts as numbers of their words (from 1), with 0 where a piece or a text ends."""
    raw = np.frombuffer(("\n".join(texts) + "\n").encode(), np.uint8)
    plain = _PLAIN[raw]
    inside = plain != 32
    start = np.flatnonzero(inside & np.r_[True, ~inside[:-1]])
    borders = np.cumsum(_BORDER[raw])[start]
    whole = pa.Array.from_buffers(pa.large_string(), 1, [None, pa.py_buffer(np.array([0, len(plain)], np.int64)), pa.py_buffer(plain)])
    parts = pc.split_pattern(whole, " ").flatten()
    coded = parts.filter(pc.greater(pc.binary_length(parts), 0)).dictionary_encode()
    number = coded.indices.to_numpy() + 1
    ends = np.r_[np.diff(borders) > 0, True][:len(start)]
    out = np.zeros(len(start) + int(ends.sum()), np.uint32)
    out[np.arange(len(start)) + np.cumsum(ends) - ends] = number
    return coded.dictionary.cast(pa.string()), out


PORTION = "lang string, n long, words array<string>, hashes binary, wide boolean, codes binary"


def portions(docs: DataFrame) -> DataFrame:
    """PORTION rows of all texts: their distinct words with 64-bit hashes that differ by language, and their codes."""
    rows = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def portion(lang: str, texts: list[str]) -> pa.RecordBatch:
        words, codes = tokens(texts)
        seed = xxhash.xxh3_64_intdigest(lang)
        hashes = np.array([xxhash.xxh3_64_intdigest(w, seed) for w in words.cast(pa.binary()).to_pylist()], np.uint64)
        wide = len(words) >= 1 << 16
        return pa.RecordBatch.from_arrays([
            pa.array([lang]), pa.array([int((codes > 0).sum())]), pa.array([words.to_pylist()], pa.list_(pa.string())), pa.array([hashes.tobytes()], pa.binary()),
            pa.array([wide]), pa.array([codes.astype(np.uint32 if wide else np.uint16).tobytes()], pa.binary())],
            ["lang", "n", "words", "hashes", "wide", "codes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[str, list[str]] = {}
            size: dict[str, int] = {}
            for lang, text in zip(batch.column(0), batch.column(1)):
                lang, text = lang.as_py(), text.as_py()
                if lang in held and size[lang] + len(text) > BYTES_AT_ONCE:
                    yield portion(lang, held.pop(lang))
                    size[lang] = 0
                held.setdefault(lang, []).append(text)
                size[lang] = size.get(lang, 0) + len(text)
            for lang, texts in held.items():
                yield portion(lang, texts)

    return rows.mapInArrow(run, PORTION)


def coded_texts(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, codes) of each portion; hashes begins with 0 for code 0."""
    for hashes, wide, codes in zip(*(batch.column(c) for c in ("hashes", "wide", "codes"))):
        yield (np.r_[np.zeros(1, np.uint64), np.frombuffer(hashes.as_py(), np.uint64)],
               np.frombuffer(codes.as_py(), np.uint32 if wide.as_py() else np.uint16))


def frequent_words(texts: DataFrame, least: int) -> DataFrame:
    """(lang, word, hash, n) of words that occur at least `least` times."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray, pa.Array]]] = {}
        rows = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal rows
            for lang, parts in held.items():
                hashes, counts, words = (np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), pa.concat_arrays([p[2] for p in parts]))
                distinct, first, place = np.unique(hashes, return_index=True, return_inverse=True)
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * len(distinct), pa.string()), words.take(pa.array(first)), pa.array(distinct.view(np.int64)),
                    pa.array(np.bincount(place, counts).astype(np.int64))], ["lang", "word", "hash", "n"])
            held.clear()
            rows = 0

        for batch in batches:
            for k, (hashes, codes) in enumerate(coded_texts(batch)):
                held.setdefault(batch.column("lang")[k].as_py(), []).append((hashes[1:], np.bincount(codes, minlength=len(hashes))[1:], batch.column("words")[k].values))
                rows += len(hashes)
                if rows > ENTRIES_AT_ONCE:
                    yield from flush()
        yield from flush()

    counted = texts.mapInArrow(run, "lang string, word string, hash long, n long")
    return counted.groupBy("lang", "word").agg(F.min("hash").alias("hash"), F.sum("n").alias("n")).where(F.col("n") >= least)


def bitmap_of(spark: SparkSession, keys: DataFrame, key: str):
    """Broadcast bitmap of 2^FILTER_BITS places with those of all keys set; whatever their number, 8 MB."""
    place = F.col(key).bitwiseAND((1 << FILTER_BITS) - 1) + 1
    parts = keys.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    out = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for r in parts.collect():
        at = (r["bucket"] - 1) * 4096
        out[at:at + 4096] = np.frombuffer(r["bits"], np.uint8)
    return spark.sparkContext.broadcast(out)


def listed(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = (keys & np.uint64(8 * len(bitmap) - 1)).astype(np.int64)
    return (bitmap[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def summed(key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, where each stands first, and the sum of its counts."""
    distinct, first, place = np.unique(key, return_index=True, return_inverse=True)
    return distinct, first, np.bincount(place, count, len(distinct)).astype(np.int64)


def met(table: pa.Table, size: int, least: int) -> pa.Table:
    """h1, h2, h3, key of the phrases of a bucket (blocks of hashes and counts) that occur at least `least` times."""
    hashes = np.concatenate([np.frombuffer(x.as_py(), np.uint64).reshape(size, -1) for x in table.column("hashes")], axis=1)
    key, first, count = summed(combined([*hashes]), np.concatenate([np.frombuffer(x.as_py(), np.uint8) for x in table.column("counts")]))
    often = count >= least
    columns = [hashes[i, first[often]] if i < size else np.zeros(int(often.sum()), np.uint64) for i in range(3)]
    return pa.table([pa.array(c.view(np.int64)) for c in (*columns, key[often])], ["h1", "h2", "h3", "key"])


def frequent_phrases(texts: DataFrame, size: int, filters: list, least: int, buckets: int) -> DataFrame:
    """(h1, h2, h3, key) of phrases of two or three words that occur at least `least` times and whose parts pass the
    filters (bitmaps of words, and for three words of pairs); h3 is 0 for pairs. Each task adds up what it reads and
    sends each distinct phrase once, with a count of at most `least`, packed by bucket."""
    schema = "bucket int, hashes binary, counts binary"

    def phrases(hashes: np.ndarray, codes: np.ndarray, maps: list[np.ndarray]) -> np.ndarray:
        """Hashes of the words of each occurrence, as columns."""
        known = listed(maps[0], hashes)
        known[0] = False
        at = np.flatnonzero(known[codes[:-1]] & known[codes[1:]])
        if size == 3:
            h = hashes[codes]
            pair = np.zeros(len(codes), bool)
            pair[at[listed(maps[1], combined([h[at], h[at + 1]]))]] = True
            at = np.flatnonzero(pair[:-1] & pair[1:])
        return hashes[np.stack([codes[at + i] for i in range(size)])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = [f.value for f in filters]
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rows = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, rows
            hashes = np.concatenate([h for _, h, _ in held], axis=1)
            key, first, count = summed(np.concatenate([k for k, _, _ in held]), np.concatenate([c for _, _, c in held]))
            hashes, count = hashes[:, first], np.minimum(count, least).astype(np.uint8)
            bucket = ((key >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            number, start = np.unique(bucket[order], return_index=True)
            stop = np.r_[start[1:], len(order)]
            cells = [(hashes[:, order[i:j]].tobytes(), count[order[i:j]].tobytes()) for i, j in zip(start.tolist(), stop.tolist())]
            held, rows = [], 0
            return pa.RecordBatch.from_arrays(
                [pa.array(number, pa.int32()), pa.array([c[0] for c in cells], pa.binary()), pa.array([c[1] for c in cells], pa.binary())], ["bucket", "hashes", "counts"])

        for batch in batches:
            for hashes, codes in coded_texts(batch):
                found = phrases(hashes, codes, maps)
                if not found.shape[1]:
                    continue
                key, first, count = summed(combined([*found]), np.ones(found.shape[1]))
                held.append((key, found[:, first], count))
                rows += len(key)
                if rows > ENTRIES_AT_ONCE:
                    yield flush()
        if held:
            yield flush()

    blocks = texts.select("hashes", "wide", "codes").mapInArrow(run, schema)
    return blocks.groupBy("bucket").applyInArrow(lambda table: met(table, size, least), "h1 long, h2 long, h3 long, key long")


@dataclass(frozen=True)
class DoubleArrayTrie:
    """A trie in two arrays: the child of state s by digit d is at base[s] + d, if check there is s.

    Words have numbers (their places in `words`, sorted hashes) and go in by two digits of base `radix`. phrase tells
    which of the phrases given ends in a state, -1 for none.
    """

    words: np.ndarray
    radix: int
    base: np.ndarray
    check: np.ndarray
    phrase: np.ndarray

    @classmethod
    def of(cls, hashes: np.ndarray, sizes: np.ndarray) -> DoubleArrayTrie:
        """Of phrases given as rows of three hashes, of which the first `size` count."""
        used = np.arange(3) < sizes[:, None]
        words, number = np.unique(hashes[used], return_inverse=True)
        radix = max(2, int(np.ceil(np.sqrt(len(words)))))
        digits = np.zeros((len(hashes), 6), np.int64)
        digits[np.repeat(used, 2, axis=1)] = np.stack([number // radix, number % radix], axis=1).reshape(-1)
        # nodes level by level: distinct (parent, digit)
        node = np.zeros(len(hashes), np.int64)
        parents, digit, nodes = [], [], 1
        for level in range(6):
            rows = np.flatnonzero(2 * sizes > level)
            pair, place = np.unique(node[rows] * radix + digits[rows, level], return_inverse=True)
            parents.append(pair // radix)
            digit.append(pair % radix)
            node[rows] = nodes + place
            nodes += len(pair)
        parent, digit = np.concatenate(parents), np.concatenate(digit)
        slot, begin = placed(parent, digit, radix)
        slots = np.r_[0, slot]  # of each node, the root first
        size = int(slots.max()) + radix + 1
        base, check, phrase = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        base[slots[parent]] = begin
        check[slot] = slots[parent]
        phrase[slots[node]] = np.arange(len(hashes))
        return cls(words, radix, base, check, phrase)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word, -1 for one that no phrase has."""
        if not len(self.words):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, at, -1)

    def step(self, state: np.ndarray, number: np.ndarray) -> np.ndarray:
        """States behind a word each, -1 where the trie does not go on."""
        for d in (number // self.radix, number % self.radix):
            ahead = self.base[state] + d
            state = np.where((state >= 0) & (number >= 0) & (self.check[ahead] == state), ahead, -1)
        return state


def placed(parent: np.ndarray, digit: np.ndarray, radix: int) -> tuple[np.ndarray, np.ndarray]:
    """(slot, base) of each child such that slot = base + digit, equal for the children of a parent, no slot used twice.

    Large families first. In each round all families that are left try a base at random, and those whose slots are free
    and claimed by no other stay; after some rounds without luck the array grows by a stretch that is wide enough.
    Only children take any free slot. Slots begin behind 0, the root's.
    """
    slot, begin = np.zeros(len(parent), np.int64), np.zeros(len(parent), np.int64)
    if not len(parent):
        return slot, begin
    order = np.argsort(parent, kind="stable")
    head = np.flatnonzero(np.r_[True, np.diff(parent[order]) > 0])
    size = np.diff(np.r_[head, len(order)])
    random = np.random.default_rng(1)
    taken = np.zeros(1, bool)
    taken[0] = True
    for width in sorted({*np.ceil(np.log2(size[size > 1])).astype(int).tolist()}, reverse=True):
        left = np.flatnonzero((size > 1) & (np.ceil(np.log2(np.maximum(size, 1))).astype(int) == width))
        most = 1 << width
        tries = 0
        while len(left):
            if tries % 8 == 0:  # room for all that are left, sparse enough that a random base is free
                room = int(size[left].sum() * max(2, min(most / 4, radix / most * 2))) + 2 * radix
                low = 1 if tries == 0 else len(taken) - radix  # first all holes, then the new stretch
                taken = np.r_[taken, np.zeros(room, bool)]
            tries += 1
            base = random.integers(low, len(taken) - radix, len(left))
            child = ragged(head[left], size[left])
            family = np.repeat(np.arange(len(left)), size[left])
            at = base[family] + digit[order[child]]
            claim = np.full(len(taken), -1, np.int32)
            claim[at[::-1]] = family[::-1]
            good = np.bincount(family, taken[at] | (claim[at] != family), len(left)) == 0
            mine = good[family]
            taken[at[mine]] = True
            slot[order[child[mine]]] = at[mine]
            begin[order[child[mine]]] = base[family[mine]]
            left = left[~good]
    single = order[head[size == 1]]
    taken = np.r_[taken, np.zeros(len(single) + radix, bool)]
    free = np.flatnonzero(~taken)
    free = free[free > radix][:len(single)]
    slot[single] = free
    begin[single] = free - digit[single]
    return slot, begin


def phrase_counts(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """(h1, h2, h3, size, n): how often each phrase (h1, h2, h3, size) stands in the texts.

    Phrases come to the driver a bounded number at a time, by a hash, and are broadcast as a trie; each trie is one pass
    over the coded texts, whose sums are written.
    """
    spark = texts.sparkSession
    shards = -(-phrases.count() // PHRASES_OF_A_TRIE)
    out = spark.createDataFrame([], "h1 long, h2 long, h3 long, size int, n long")
    for shard in range(shards):
        own = phrases.where(F.pmod(F.xxhash64("h1", "h2", "h3"), F.lit(shards)) == shard).select("h1", "h2", "h3", "size").toArrow()
        hashes = np.stack([own.column(c).to_numpy() for c in ("h1", "h2", "h3")], axis=1).view(np.uint64)
        sizes = own.column("size").to_numpy()
        trie = spark.sparkContext.broadcast(DoubleArrayTrie.of(hashes, sizes))
        names = spark.sparkContext.broadcast((hashes, sizes))
        out = out.union(written(_counted(texts, trie, names), "counts"))
        for sent in (trie, names):  # else executors hold all of them until the driver collects its garbage
            sent.destroy()
    return out


def _counted(texts: DataFrame, trie, names) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = trie.value
        total = np.zeros(len(names.value[1]), np.int64)
        for batch in batches:
            for hashes, codes in coded_texts(batch):
                number = t.numbers(hashes)
                number[0] = -1
                # the first level is the same for all places of a word
                state = t.step(np.zeros(len(number), np.int64), number)[codes]
                at = np.flatnonzero(state >= 0)
                state = state[at]
                for level in range(3):
                    if level:
                        at = at + 1  # a portion ends with code 0, so there is a next place
                        state = t.step(state, number[codes[at]])
                        go = state >= 0
                        at, state = at[go], state[go]
                    ends = t.phrase[state]
                    total += np.bincount(ends[ends >= 0], minlength=len(total))
        found = np.flatnonzero(total)
        block = found >> BLOCK_BITS
        start = np.flatnonzero(np.r_[True, np.diff(block) > 0]) if len(found) else found
        cells = [(int(block[i]), (found[i:j] & ((1 << BLOCK_BITS) - 1)).astype(np.uint16).tobytes(), total[found[i:j]].tobytes())
                 for i, j in zip(start.tolist(), np.r_[start[1:], len(found)].tolist())] if len(found) else []
        yield pa.RecordBatch.from_arrays(
            [pa.array([c[0] for c in cells], pa.int32()), pa.array([c[1] for c in cells], pa.binary()), pa.array([c[2] for c in cells], pa.binary())], ["block", "places", "counts"])

    def add(table: pa.Table) -> pa.Table:
        first = table.column("block")[0].as_py() << BLOCK_BITS
        total = np.zeros(1 << BLOCK_BITS, np.int64)
        for places, counts in zip(table.column("places"), table.column("counts")):
            total[np.frombuffer(places.as_py(), np.uint16)] += np.frombuffer(counts.as_py(), np.int64)
        at = np.flatnonzero(total)
        hashes, sizes = names.value
        own = hashes[first + at].view(np.int64)
        return pa.table([*(pa.array(own[:, i]) for i in range(3)), pa.array(sizes[first + at], pa.int32()), pa.array(total[at])], ["h1", "h2", "h3", "size", "n"])

    sums = texts.select("hashes", "wide", "codes").mapInArrow(run, "block int, places binary, counts binary")
    return sums.groupBy("block").applyInArrow(add, "h1 long, h2 long, h3 long, size int, n long")


def cut_score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)) in whole numbers of up to 38 digits: exact for counts up to 10^15."""
    whole = lambda c: c.cast("decimal(15,0)")
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * whole(a) * whole(a), whole(left) * whole(right))


def scored(words: DataFrame, counts: DataFrame, share: int) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the candidates that no longer one holds in `share` percent of their places."""
    ones = counts.where("size = 1").select(F.col("h1").alias("hash"), F.col("n").alias("f")).join(words.select("hash", "lang", "word"), "hash")
    left = ones.select(F.col("hash").alias("h1"), F.col("f").alias("l"), "lang", F.col("word").alias("first"))
    right = ones.select(F.col("hash").alias("h2"), F.col("f").alias("r"), F.col("word").alias("second"))
    pairs = counts.where("size = 2").select("h1", "h2", F.col("n").alias("a")).join(left, "h1").join(right, "h2").select(
        "h1", "h2", "lang", F.concat_ws(" ", "first", "second").alias("phrase"), "a", "l", "r", cut_score(F.col("a"), F.col("l"), F.col("r")).alias("score"))
    pairs = written(pairs, "pairs")
    begin = pairs.select("h1", "h2", F.col("a").alias("l2"))
    end = pairs.select(F.col("h1").alias("h2"), F.col("h2").alias("h3"), F.col("a").alias("r1"), F.col("phrase").alias("rest"))
    third = ones.select(F.col("hash").alias("h3"), F.col("f").alias("r2"))
    one, two = cut_score(F.col("a"), F.col("l"), F.col("r1")), cut_score(F.col("a"), F.col("l2"), F.col("r2"))
    later = two < one
    triples = counts.where("size = 3").select("h1", "h2", "h3", F.col("n").alias("a")).join(left, "h1").join(third, "h3").join(begin, ["h1", "h2"]).join(end, ["h2", "h3"])
    triples = triples.select(
        "h1", "h2", "h3", "lang", F.concat_ws(" ", "first", "rest").alias("phrase"), "a", F.when(later, F.col("l2")).otherwise(F.col("l")).alias("l"),
        F.when(later, F.col("r2")).otherwise(F.col("r1")).alias("r"), F.least(one, two).alias("score"))
    triples = written(triples, "triples")
    longer = triples.select("h1", "h2", "a").union(triples.select("h2", "h3", "a")).groupBy("h1", "h2").agg(F.max("a").alias("longest"))
    free = pairs.join(longer, ["h1", "h2"], "left").where(F.col("longest").isNull() | (100 * F.col("longest") < share * F.col("a")))
    shown = ["lang", "phrase", "a", "l", "r", "score"]
    return free.select(*shown).union(triples.select(*shown))


def collocations(docs: DataFrame, least: int = LEAST, share: int = SHARE, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): for each language its first `top` phrases of two or three words.

    Texts, A-Z in lower case, are cut into pieces at . , ; : ! ? and line breaks, pieces into words at blanks and tabs;
    phrases lie within a piece. a counts the places of a phrase, l and r those of its two parts at the cut with the least
    score (of equal ones the first), n all words of the language. Candidates have `least` places; one is dropped if its
    words lie inside a longer candidate with at least `share` percent of its places. Order: score, a, both descending,
    phrase (bytes in UTF-8).

    A null text is empty, a null language `und`; an id is not used, and repeated rows count as often as they stand. An
    empty table, or one without candidates, gives an empty one; other columns are ignored. Words are told apart by
    64-bit hashes, so two of n words are taken for one with a chance of n^2 / 2^65. Counts are exact.
    """
    spark = docs.sparkSession
    texts = written(portions(docs), "portions", GROUP_BYTES)
    totals = texts.groupBy("lang").agg(F.sum("n").alias("n"))
    buckets = max(1, (texts.agg(F.sum("n")).first()[0] or 0) // PHRASES_OF_A_BUCKET)
    words = written(frequent_words(texts, least), "words")
    filters = [bitmap_of(spark, words, "hash")]
    pairs = written(frequent_phrases(texts, 2, filters, least, buckets), "pairs")
    filters.append(bitmap_of(spark, pairs, "key"))
    triples = written(frequent_phrases(texts, 3, filters, least, buckets), "triples")
    for bitmap in filters:
        bitmap.destroy()
    none = F.lit(0).cast("long")
    phrases = words.select(F.col("hash").alias("h1"), none.alias("h2"), none.alias("h3"), F.lit(1).alias("size"))
    for size, found in ((2, pairs), (3, triples)):
        phrases = phrases.union(found.select("h1", "h2", "h3", F.lit(size)))
    # a bitmap lets some phrases pass that share places with frequent ones; only what is counted often enough is a candidate
    counts = phrase_counts(texts, phrases).where(F.col("n") >= least)
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    found = scored(words, counts, share).withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*best))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
