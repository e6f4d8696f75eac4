"""Near-duplicate documents by bottom-k sketches of one hash function.

A document is the set of its word shingles. Sets that are equal become one node first, so exact copies cost nothing
further. A node keeps the k smallest hashes of its set. Inverted lists over runs of neighbouring retained values bring
nodes together; the sketch of the union of two nodes, which is the k smallest of both sketches, estimates their
similarity; what may reach the threshold is verified on the full sets.

Lists of one text's many variants are long, so their pairs are never all written out. First every member of a list is
compared with the list's leader only, and the links found are closed to components. Lists whose members are then all of
one component have nothing left to tell. The members of the others are compared across components, block by block inside
tasks, and only pairs that pass the estimate leave the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadfit.llm.common import texts_of, written

K = 256  # retained values
INDEXED = 48  # smallest retained values whose runs are indexed
RUN = 3  # neighbouring values in a key of the index
SHORT = 16  # sets up to this size are indexed by runs of 2 as well
MARGIN = 4.5  # standard deviations that an estimate may lie below the threshold
FEW = 12  # smallest values whose lists bring the last open nodes together
PAIRED = 8  # members up to which a list's pairs are written out
SURE = 3  # pairs of two components that are passed on where an estimate leaves no doubt: each fails with a chance of 3.4e-6
BLOCK = 1024  # members of a long list that are compared with as many others at once
PREFILTER_SLOTS = 1 << 18  # bound of the ids that are sent to the scan of texts
BYTES_AT_ONCE = 4 << 20
ROWS_AT_ONCE = 256  # rows of a block that are compared with the others at once

_P1, _P2, _P3 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _P2
    x = (x ^ (x >> np.uint64(29))) * _P3
    return x ^ (x >> np.uint64(32))


def combined(parts: list[np.ndarray]) -> np.ndarray:
    """Hash of equally long sequences of hashes, in order."""
    x = np.full(len(parts[0]), len(parts), np.uint64)
    for p in parts:
        x = mixed(x * _P1 + p)
    return x


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit fingerprints of each text's shingles of `size` words; of fewer words, of the whole sequence.

    Words are runs without ASCII white space, A-Z in lower case.
    """
    # a compact copy: Arrow's ASCII kernels misread slices of arrays
    plain = pa.array([t or "" for t in texts.to_pylist()], pa.large_string())
    plain = pc.ascii_trim_whitespace(pc.ascii_lower(plain))
    pieces = pc.ascii_split_whitespace(plain)
    end = pieces.offsets.to_numpy()[1:] - pieces.offsets.to_numpy()[0]
    coded = pieces.flatten().dictionary_encode()
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()], np.uint64)
    word = hashes[coded.indices.to_numpy()] if len(hashes) else np.zeros(0, np.uint64)
    begin = 0
    shingles = combined([word[i:len(word) - size + 1 + i] for i in range(size)]) if len(word) >= size else word[:0]
    for stop, is_empty in zip(end.tolist(), pc.equal(plain, "").to_pylist()):
        if is_empty:
            yield word[:0]
        elif stop - begin < size:
            yield combined([word[i:i + 1] for i in range(begin, stop)])
        else:
            yield np.unique(shingles[begin:stop - size + 1])
        begin = stop


def portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of batches in portions of bounded text."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy())
        first = 0
        while first < len(size):
            before = size[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(size, before + BYTES_AT_ONCE, "right")))
            yield batch.slice(first, last - first)
            first = last


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, text_key, n_shingles, node, sketch): node is a 64-bit hash of the whole set, null for an empty one; sketch holds the
    upper halves of its K smallest fingerprints, in order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in portions(batches):
            size, node, sketch = [], [], []
            for x in shingle_sets(rows.column("text"), words):
                size.append(len(x))
                node.append(np.uint64(xxhash.xxh3_64_intdigest(x.tobytes())).astype(np.int64).item() if len(x) else None)
                sketch.append((x[:K] >> np.uint64(32)).astype("<u4").tobytes() if len(x) else None)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), rows.column("text_key"), pa.array(size, pa.int64()), pa.array(node, pa.int64()), pa.array(sketch, pa.binary())],
                ["doc_id", "text_key", "n_shingles", "node", "sketch"],
            )

    return texts_of(docs).withColumn("text_key", F.xxhash64("text")).mapInArrow(run, "doc_id long, text_key long, n_shingles long, node long, sketch binary")


def run_keys(sketch: np.ndarray) -> np.ndarray:
    """Index keys of a node: runs of RUN neighbouring values among its smallest, and of 2 for a short set.

    Two sets of similarity s are alike in all but a share 1 - s of the values of their union. Full sketches of similar
    sets always share a run (with at most (1 - s) u odd values among u, some run of common ones is long enough; hence
    the runs of 2 for short sets). Of longer sets, the chance that INDEXED values hold no common run is 2e-10 at a
    similarity of 0.85, 3e-8 at 0.8.
    """
    x = sketch[:INDEXED].astype(np.uint64)
    keys = []
    for length in (2, RUN) if len(sketch) <= SHORT else (RUN,):
        if len(x) >= length:
            keys.append(combined([x[i:len(x) - length + 1 + i] for i in range(length)]))
    return np.concatenate(keys) if keys else x[:0]


def postings(nodes: DataFrame) -> DataFrame:
    """(key, node): the inverted lists."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [run_keys(np.frombuffer(s, "<u4")) for s in batch.column("sketch").to_pylist()]
            node = np.repeat(batch.column("node").to_numpy(), [len(k) for k in keys])
            key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(node)], ["key", "node"])

    return nodes.select("node", "sketch").mapInArrow(run, "key long, node long")


def passes(common: np.ndarray, left: np.ndarray, right: np.ndarray, full: np.ndarray, threshold: float) -> np.ndarray:
    """Whether pairs may reach the threshold, from the sketch of their union.

    Up to the smaller of the two sketches' last values both sets are known: left and right are their numbers of values
    up to there, common the shared ones. Of left + right - common values of the union the share of common ones estimates
    the similarity; where both sketches hold the full sets it is exact.
    """
    share, doubt = estimated(common, left, right, full, threshold)
    return share >= threshold - doubt


def estimated(common: np.ndarray, left: np.ndarray, right: np.ndarray, full: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The estimate and how far it may be off at the threshold."""
    union = np.maximum(left + right - common, 1)
    return common / union, np.where(full, 1e-9, MARGIN * np.sqrt(threshold * (1 - threshold) / union))


def last_value(sketch: np.ndarray) -> int:
    """The value up to which a set is known: its sketch's last, or beyond all for a full set."""
    return int(sketch[-1]) if len(sketch) >= K else 2**32


def likely(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) whose sizes and sketches allow the threshold."""
    x = nodes.select("node", "n", "sketch")
    left, right = (x.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("sketch").alias(f"sketch_{s}")) for s in "ab")
    joined = pairs.join(left, "a").join(right, "b").where(
        F.least("n_a", "n_b") >= F.lit(threshold - 1e-9) * F.greatest("n_a", "n_b"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            seen = np.zeros((len(t), 4), np.int64)
            for row, p, q in zip(seen, t["sketch_a"], t["sketch_b"]):
                x, y = np.frombuffer(p, "<u4"), np.frombuffer(q, "<u4")
                known = min(last_value(x), last_value(y))
                row[:] = (
                    len(np.intersect1d(x, y, assume_unique=True)), np.searchsorted(x, known, "right"),
                    np.searchsorted(y, known, "right"), known == 2**32)
            yield t.loc[passes(seen[:, 0], seen[:, 1], seen[:, 2], seen[:, 3] == 1, threshold), ["a", "b"]]

    return joined.mapInPandas(run, "a long, b long")


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= percent * union."""
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    ids = nodes.join(wanted, "node").select("node", F.col("rep").alias("doc_id"))
    # a bounded set of slots spares the shuffle most of the texts that no pair asks for
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(PREFILTER_SLOTS)).cast("int")
    slots = ids.select(slot.alias("slot")).distinct()
    rows = texts_of(docs).withColumn("slot", slot).join(F.broadcast(slots), "slot", "left_semi").drop("slot")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in portions(batches):
            found = [x.view(np.int64) for x in shingle_sets(t.column("text"), words)]
            hashes = [np.uint64(xxhash.xxh3_64_intdigest(x.tobytes())).astype(np.int64).item() for x in found]
            mine = np.array([h == n for h, n in zip(hashes, t.column("node").to_pylist())], bool)
            items = pa.ListArray.from_arrays(
                pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *found])))
            yield pa.RecordBatch.from_arrays([t.column("node"), items], ["node", "items"]).filter(pa.array(mine))

    # an id that stands on several texts gives the text that the node was made of
    full = written(rows.join(ids, "doc_id").mapInArrow(sets, "node long, items array<long>").dropDuplicates(["node"]), "sets")
    left, right = (full.select(F.col("node").alias(s), F.col("items").alias(f"items_{s}")) for s in "ab")

    common = F.size(F.array_intersect("items_a", "items_b"))
    union = F.size("items_a") + F.size("items_b") - common
    return pairs.join(left, "a").join(right, "b").where(100 * common.cast("long") >= percent * union.cast("long")).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(node, label) of all linked nodes: label is the smallest node that links lead to.

    Each round takes the smallest label next to a node and then the label of that label; every round is written.
    """
    edges = written(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = written(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        step = labels.join(near, "node").select("node", "label", F.least("label", "m").alias("next"))
        jump = step.select(F.col("node").alias("next"), F.col("next").alias("further"))
        moved = written(
            step.join(jump, "next").select("node", F.col("label").alias("was"), F.least("next", "further").alias("label")), "labels")
        labels = moved.select("node", "label")
        if moved.where("label < was").isEmpty():
            return labels


def unresolved_pairs(lists: DataFrame, nodes: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """Pairs of nodes of different components that share a list whose members are not all of one component.

    Nodes of such lists meet again in the lists of their FEW smallest values, which two similar sets almost surely share
    (one of FEW is common but for a chance of (1 - s)^FEW), and there only with sets of like size. Long lists are dealt
    into blocks of about BLOCK members by a hash, and every two blocks of a list are compared in one task, so no task
    and no table holds all pairs of a long list.
    """
    named = lists.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    mixed_ = named.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("label").alias("low"), F.max("label").alias("high"))
    mixed_ = mixed_.where((F.col("low") < F.col("high")) & (F.col("size") > 2)).select("key")
    open_ = named.join(mixed_, "key").groupBy("node").agg(F.first("label").alias("label"))
    met = written(_small_values(open_.join(nodes, "node"), threshold), "met")
    sizes = met.groupBy("key").agg(
        F.count(F.lit(1)).alias("size"), F.min("label").alias("low"), F.max("label").alias("high"), F.min("lower").alias("all_lower"))
    sizes = sizes.where((F.col("low") < F.col("high")) & ~F.col("all_lower"))
    # short lists: their few pairs
    short = met.join(sizes.where(F.col("size") <= PAIRED).select("key"), "key")
    other = short.select("key", F.col("node").alias("b"), F.col("label").alias("label_b"), F.col("lower").alias("lower_b"))
    few = short.join(other, "key").where("node < b AND label <> label_b AND NOT (lower AND lower_b)")
    few = likely(few.select(F.col("node").alias("a"), "b").distinct(), nodes, threshold)
    # long lists: blocks
    blocks = sizes.where(F.col("size") > PAIRED).select("key", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    dealt = met.join(blocks, "key").select(
        "key", "node", "label", "lower", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int").alias("block"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", "node", "label", "lower", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    rows = dealt.join(nodes.select("node", "n", "sketch"), "node")

    def run(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
        value_key, i, j = key
        t = t.sort_values("node", ignore_index=True)
        a, b = allowed_pairs(t, threshold, None if i == j else (t["block"] == i).to_numpy())
        # of the lists that a pair shares only that of its smallest common value passes it on
        values = [np.frombuffer(x, "<u4") for x in t["sketch"]]
        smallest = np.array([np.intersect1d(values[p], values[q], assume_unique=True)[:1] for p, q in zip(a.tolist(), b.tolist())], np.uint64).reshape(-1)
        span = size_range(t["n"].to_numpy(), threshold)
        own = combined([smallest, np.maximum(span[a], span[b])]).view(np.int64) == value_key
        node = t["node"].to_numpy()
        return pd.DataFrame({"a": node[a[own]], "b": node[b[own]]})

    pairs = rows.groupBy("key", "i", "j").applyInPandas(run, "a long, b long")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).union(few).distinct()


def size_range(n: np.ndarray, threshold: float) -> np.ndarray:
    """Ranges of sizes so wide that similar sets lie in the same or in neighbouring ones."""
    return np.floor(np.log(n) / -np.log(threshold - 1e-6)).astype(np.uint64)


def _small_values(nodes: DataFrame, threshold: float) -> DataFrame:
    """(key, node, label, lower): a key for each of the FEW smallest values of a node and each of two neighbouring ranges
    of sizes, the node's own and the one above (lower: the node is from the range below that of the key)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            values = [np.frombuffer(s, "<u4")[:FEW].astype(np.uint64) for s in t.column("sketch").to_pylist()]
            count = np.array([len(v) for v in values], np.int64)
            value = np.concatenate(values) if values else np.zeros(0, np.uint64)
            span = size_range(t.column("n").to_numpy(), threshold)
            span = np.repeat(span, count)
            key = np.concatenate([combined([value, span]), combined([value, span + np.uint64(1)])])
            node, label = (np.tile(np.repeat(t.column(c).to_numpy(), count), 2) for c in ("node", "label"))
            lower = np.repeat([False, True], len(value))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(node), pa.array(label), pa.array(lower)], ["key", "node", "label", "lower"])

    return nodes.select("node", "label", "n", "sketch").mapInArrow(run, "key long, node long, label long, lower boolean")


def allowed_pairs(t: pd.DataFrame, threshold: float, left: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Positions of pairs of rows (node, n, sketch, label, lower) of different labels that sizes and sketches allow, as
    many as can matter for linking the labels; with left, only pairs of one row of it and one outside."""
    sketches = [np.frombuffer(s, "<u4") for s in t["sketch"]]
    n, label = t["n"].to_numpy(np.int32), t["label"].to_numpy()
    value, code = np.unique(np.concatenate(sketches), return_inverse=True)
    row = np.repeat(np.arange(len(sketches)), [len(s) for s in sketches])
    often = np.bincount(code, minlength=len(value)) > 1
    column = np.cumsum(often) - 1
    member = np.zeros((len(sketches), int(often.sum())), np.float32)
    member[row[often[code]], column[code[often[code]]]] = 1
    lower = t["lower"].to_numpy(bool)
    last = np.array([last_value(x) for x in sketches])
    a, b, share, told, sure = [], [], [], [], []
    for first in range(0, len(sketches), ROWS_AT_ONCE):
        rows = np.arange(first, min(first + ROWS_AT_ONCE, len(sketches)))
        if left is not None:
            rows = rows[left[rows]]
        common = member[rows] @ member.T
        apart = label[rows][:, None] != label
        apart &= ~(lower[rows][:, None] & lower)  # those meet in the range below
        apart &= rows[:, None] < np.arange(len(sketches)) if left is None else ~left
        apart &= np.minimum.outer(n[rows], n) >= (threshold - 1e-9) * np.maximum.outer(n[rows], n)
        # values of either side up to the last known one of both
        mine = np.stack([np.searchsorted(sketches[i], np.minimum(last, last[i]), "right") for i in rows.tolist()]).astype(np.int32) if len(rows) else common
        theirs = np.stack([np.searchsorted(x, np.minimum(last[rows], own), "right") for x, own in zip(sketches, last)], axis=1).astype(np.int32)
        full = (last[rows] == 2**32)[:, None] & (last == 2**32)
        guess, doubt = estimated(common, mine, theirs, full, threshold)
        i, j = np.nonzero(apart & (guess >= threshold - doubt))
        a.append(rows[i])
        b.append(j)
        share.append(guess[i, j])
        told.append(full[i, j])
        sure.append(guess[i, j] >= np.where(full[i, j], threshold - 1e-9, threshold + doubt[i, j]))
    a, b, share, told, sure = map(np.concatenate, (a, b, share, told, sure))
    # two components need no more than one link: SURE pairs of best estimate where there are such, else all pairs
    found = pd.DataFrame({
        "a": a, "b": b, "open": ~sure, "guess": ~told, "share": -share,
        "x": np.minimum(label[a], label[b]), "y": np.maximum(label[a], label[b])}).sort_values(["open", "guess", "share", "a", "b"])
    pairs = found.groupby(["x", "y"])
    best = pairs[["open", "guess"]].transform("first").astype(bool)
    place = pairs.cumcount()
    exact = found[~best["open"] & ~best["guess"] & (place == 0)]
    rest = found[~best["open"] & best["guess"] & (place < SURE) | best["open"]]
    kept = pd.concat([exact[spanning(exact["x"].tolist(), exact["y"].tolist())], rest])
    return kept["a"].to_numpy(), kept["b"].to_numpy()


def spanning(x: list[int], y: list[int]) -> np.ndarray:
    """Which of the links x - y, in order, join what those before have not joined yet."""
    above: dict[int, int] = {}

    def top(v: int) -> int:
        while above.setdefault(v, v) != v:
            above[v] = above[above[v]]
            v = above[v]
        return v

    out = np.zeros(len(x), bool)
    for k, (v, w) in enumerate(zip(x, y)):
        v, w = top(v), top(w)
        if v != w:
            above[w] = v
            out[k] = True
    return out


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs.

    Two documents are linked where 100 * intersection >= percent * union of their shingle sets; component_id is the
    smallest doc_id that links lead to, the document itself included, and kept marks the document that bears it.
    Fingerprints have 64 bits, so unequal shingles of two sets of n count as equal with a chance of n^2 / 2^64. A pair of
    sets over K shingles at the threshold itself is refused by its estimate with a chance of 1e-5; the further above, the
    less. Sets of up to K shingles are never missed for the estimate.

    A null or empty text, or one without words, has no shingles and is linked with nothing: it is its own component. A
    row without doc_id is linked with nothing, has a null component and is kept. Rows that repeat an id with the same
    text are copies of each other and bear the same component. An empty table gives an empty one; other columns are
    ignored. percent must be at least 80.
    """
    return _judged(docs, words, percent).drop("text_key")


def _judged(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """near_duplicates with a hash of each row's text."""
    if percent < 80:
        raise ValueError("the index finds all links only from 80 percent on")
    threshold = percent / 100
    sig = written(signatures(docs, words), "signatures")
    nodes = written(
        sig.where(F.col("node").isNotNull() & F.col("doc_id").isNotNull()).groupBy("node").agg(
            F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")), "nodes")
    lists = postings(nodes)
    leaders = lists.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("leader")).where("size > 1")
    lists = written(lists.join(leaders, "key").select("key", "node", "leader"), "lists")
    stars = lists.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    links = written(verified(written(likely(stars, nodes, threshold), "pairs"), nodes, docs, words, percent), "links")
    labels = components(links)
    rest = written(unresolved_pairs(lists.select("key", "node"), nodes, labels, threshold), "pairs")
    if not rest.isEmpty():
        more = written(verified(rest, nodes, docs, words, percent), "links")
        if not more.isEmpty():
            labels = components(links.union(more))
    named = nodes.join(labels, "node").select("node", "rep", "label")
    smallest = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    found = named.join(smallest, "label").select("node", "component_id")
    # nodes without links: their copies still share the smallest id
    own = nodes.join(found, "node", "left").select("node", F.coalesce("component_id", "rep").alias("component_id"))
    with_id = sig.select("doc_id", "text_key", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node"))
    linked = with_id.where(F.col("node").isNotNull()).join(own, "node").select("doc_id", "text_key", "n_shingles", "component_id")
    alone = with_id.where(F.col("node").isNull()).select("doc_id", "text_key", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with all their columns as they are, that near_duplicates keeps: one document of each group.

    Rows are judged by id and text: of an id that stands on several texts only the copies of others go. Of rows that
    repeat both id and text one stays, the first by its other columns as JSON. Rows without id all stay.
    """
    gone = _judged(docs, words, percent).where("NOT kept").select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).distinct()
    same = (docs["doc_id"].cast("long") == gone["gone_id"]) & (F.xxhash64(docs["text"].cast("string")) == gone["gone_key"])
    kept = docs.join(gone, same, "left_anti")
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    with_id = kept.where(F.col("doc_id").isNotNull())
    if others:
        one = with_id.groupBy("doc_id", "text").agg(F.min_by(F.struct(*others), F.to_json(F.struct(*others))).alias("others"))
        with_id = one.select(*(F.col(c if c in ("doc_id", "text") else f"others.{c}").alias(c) for c in docs.columns))
    else:
        with_id = with_id.distinct()
    return with_id.unionByName(kept.where(F.col("doc_id").isNull()))
