"""Best-two-fit packing of token pieces into sequences of fixed capacity.

Lengths are whole numbers up to the capacity, so all pieces of one length are alike: the plan is made over the count of
each length (at most `capacity` numbers, whatever the corpus) and says which lengths share a bin and how often that bin
is repeated. A piece then needs only its rank among the pieces of its length to know its sequence and its place there.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadfit.llm.bpe import encoded_portions, encoder_of, ragged, share_tokenizer
from leadfit.llm.common import texts_of, written

CAPACITY = 2048
END_ID = 0


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Bins as (repeats, [(length, uses), ...]) that hold `counts[length]` pieces of each length.

    A bin takes the longest piece that still fits, again and again. Then its smallest piece gives way to the two
    unpacked pieces that fit the gap it leaves more tightly, if there are such; a bin of one piece stays as it is.
    A bin is repeated as long as all its lengths last, as the next bin would come out the same.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    lengths = sorted(left)
    bins = []
    while lengths:
        uses: dict[int, int] = {}
        gap, at = capacity, len(lengths) - 1
        while gap and at >= 0:
            at = min(at, bisect_right(lengths, gap) - 1)
            if at < 0:
                break
            n = lengths[at]
            fit = min(gap // n, left[n] - uses.get(n, 0))
            if fit:
                uses[n] = uses.get(n, 0) + fit
                gap -= fit * n
            at -= 1
        if gap and sum(uses.values()) > 1:
            smallest = min(uses)
            pair = _tighter_pair(lengths, left, uses, smallest, gap + smallest)
            if pair:
                uses[smallest] -= 1
                for n in pair:
                    uses[n] = uses.get(n, 0) + 1
        uses = {n: u for n, u in uses.items() if u}
        repeats = min(left[n] // u for n, u in uses.items())
        bins.append((repeats, sorted(uses.items(), reverse=True)))
        for n, u in uses.items():
            left[n] -= u * repeats
            if not left[n]:
                del lengths[bisect_right(lengths, n) - 1]
    return bins


def _tighter_pair(lengths: list[int], left: dict[int, int], uses: dict[int, int], smallest: int, room: int) -> tuple[int, int] | None:
    """The two unpacked pieces of largest sum over `smallest` and up to `room`."""
    free = lambda n: left[n] - uses.get(n, 0)
    best, pair = smallest, None
    low, high = 0, bisect_right(lengths, room - 1) - 1
    while low <= high:
        a, b = lengths[low], lengths[high]
        if not free(b):
            high -= 1
        elif not free(a):
            low += 1
        elif a + b > room:
            high -= 1
        elif low == high and free(a) < 2:
            break
        else:
            if a + b > best:
                best, pair = a + b, (b, a)
                if best == room:
                    break
            low += 1
    return pair


def placement(bins: list[tuple[int, list[tuple[int, int]]]]) -> dict[str, np.ndarray]:
    """Runs of ranks within each length: the piece of rank r in a run of a bin repeated k times is copy (r - first) // k
    of its length in repeat (r - first) % k of that bin. Sorted by length and first rank."""
    rows, sequence, used = [], 0, {}
    for repeats, parts in bins:
        offset = 0
        for n, uses in parts:
            rows.append((n, used.get(n, 0), repeats, sequence, offset))
            used[n] = used.get(n, 0) + repeats * uses
            offset += n * uses
        sequence += repeats
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "repeats", "sequence", "offset"), table.T.copy()))


def pieces_of(docs: DataFrame, tokenizer_path: str, capacity: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, rank): each document's ids and one END_ID, cut every `capacity`.

    rank counts the pieces of the same length in the same part, a partition of the scan. No shuffle.
    """
    shared = share_tokenizer(docs.sparkSession, tokenizer_path)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shared)
        seen = np.zeros(capacity + 1, np.int64)
        for rows, ids, count in encoded_portions(encoder, batches):
            with_end = np.full(len(ids) + len(count), END_ID, "<u4")
            with_end[ragged(np.cumsum(count + 1) - count - 1, count)] = ids
            total = count + 1
            pieces = -(-total // capacity)
            doc = np.repeat(np.arange(len(total)), pieces)
            piece = ragged(np.zeros(len(total), np.int64), pieces)
            start = piece * capacity
            length = np.minimum(total[doc] - start, capacity)
            begin = (np.cumsum(total) - total)[doc] + start
            crc = [zlib.crc32(with_end[b:b + n]) for b, n in zip(begin.tolist(), length.tolist())]
            order = np.argsort(length, kind="stable")
            run_length, run_start, run_count = np.unique(length[order], return_index=True, return_counts=True)
            rank = np.empty(len(length), np.int64)
            rank[order] = np.arange(len(length)) - np.repeat(run_start, run_count) + np.repeat(seen[run_length], run_count)
            seen[run_length] += run_count
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id").take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(rank)], names,
            )

    made = texts_of(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, rank long")
    return made.withColumn("part", F.spark_partition_id())


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Place every document's tokens in sequences of at most `capacity`, in as few as best-two-fit needs.

    Returns (doc_id, piece, start, length, ids_crc32, sequence_id, offset) per piece. A document is its token ids and
    END_ID; only one that is longer than `capacity` is cut, and its last piece may be shorter. Pieces of a sequence lie
    one after another from offset 0 without gaps.

    A null or empty text is END_ID alone; a null doc_id stays null; repeated rows are packed each by itself; an empty
    table gives an empty one; other columns are ignored. Pieces of one length may change places between two runs only
    if the input is split differently; their number, cuts and checksums never change.
    """
    spark = docs.sparkSession
    pieces = written(pieces_of(docs, tokenizer_path, capacity), "pieces")
    per_part = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    # at most `capacity` numbers come to the driver
    totals = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = spark.sparkContext.broadcast(placement(best_two_fit(totals, capacity)))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = per_part.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    ranked = pieces.join(base, ["part", "length"]).withColumn("rank", F.col("base") + F.col("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = runs.value
        stride = np.int64(1) << 48  # over any number of pieces
        keys = r["length"] * stride + r["first"]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            run = np.searchsorted(keys, length * stride + rank, "right") - 1
            copy, repeat = np.divmod(rank - r["first"][run], r["repeats"][run])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(r["sequence"][run] + repeat), pa.array(r["offset"][run] + copy * length)],
                [*batch.schema.names[:-1], "sequence_id", "offset"],
            )

    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.select(*columns, "rank").mapInArrow(place, schema)


def packed_sequences(docs: DataFrame, placed: DataFrame, tokenizer_path: str) -> DataFrame:
    """(sequence_id, ids, doc_ids): the token arrays themselves, from documents with distinct ids and their placement.

    A sequence holds at most its capacity of tokens, so no group grows with the corpus.
    """
    from leadfit.llm.bpe import encode_documents

    ids = encode_documents(docs, tokenizer_path).select("doc_id", F.concat("ids", F.array(F.lit(END_ID))).alias("all_ids"))
    part = F.slice("all_ids", (F.col("start") + 1).cast("int"), F.col("length").cast("int"))
    rows = placed.join(ids, "doc_id").select("sequence_id", F.struct("offset", "doc_id", part.alias("ids")).alias("p"))
    return rows.groupBy("sequence_id").agg(F.array_sort(F.collect_list("p")).alias("p")).select(
        "sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"))
