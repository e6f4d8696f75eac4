"""Exact search for the largest inner products, over candidates in order of descending length.

Vectors are whole numbers. They are rotated by the singular vectors of all candidates, so that the first coordinates
carry most of a product; candidates are sorted by length into blocks. A block is left out for a query once its longest
vector can't reach the query's k-th score so far (Cauchy-Schwarz). Inside a block a partial sum over the first
coordinates plus the product of the remaining lengths bounds each score, and only what may still count is scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadfit.llm.common import written

CANDIDATES_IN_BLOCK = 4096
QUERIES_IN_BLOCK = 512
HEAD_SHARE = 0.5  # of the squared length that the first coordinates of a product carry
LEVEL_STEP = 1.1  # lengths of one level differ at most by this factor
SLACK = 1e-9  # of the product of the lengths: over the rounding of floats


def whole_vectors(vectors: DataFrame, id_column: str, vector_column: str, scale: int) -> DataFrame:
    """(id, v): floor(scale * x) of each component; vectors that are null or hold a null or non-finite one are left out,
    and so are rows without id."""
    x = F.col(vector_column).cast("array<double>")
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), x.alias("x")).where(
        F.col("id").isNotNull() & F.col("x").isNotNull()
        & F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf"))))
    return rows.select("id", F.transform("x", lambda e: F.floor(e * scale)).alias("v"))


def rotation(rows: DataFrame) -> np.ndarray:
    """Right singular vectors of all vectors, from the sums of products of their coordinates (width^2 numbers)."""
    def gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((0, 0))
        for t in batches:
            x = matrix(t["v"])
            g = x.T @ x
            if len(g) < len(total):
                g, total = total, g
            grown = np.zeros_like(g)
            grown[:len(total), :len(total)] = total
            total = g + grown
        i, j = np.nonzero(total)
        yield pd.DataFrame({"i": i, "j": j, "s": total[i, j]})

    sums = rows.select("v").mapInPandas(gram, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    width = 1 + max((max(r["i"], r["j"]) for r in sums), default=-1)
    total = np.zeros((width, width))
    for r in sums:
        total[r["i"], r["j"]] = r["s"]
    return np.linalg.eigh(total)[1][:, ::-1] if width else total


def matrix(vectors: pd.Series, width: int = 0) -> np.ndarray:
    """Rows of whole numbers as floats; missing coordinates of shorter vectors are 0."""
    width = max([width, *(len(v) for v in vectors)]) if len(vectors) else width
    out = np.zeros((len(vectors), width))
    for row, v in zip(out, vectors):
        row[:len(v)] = v
    return out


def packed(rows: list[np.ndarray], ids: np.ndarray) -> dict:
    width = max(map(len, rows), default=0)
    out = np.zeros((len(rows), width), np.int64)
    for to, v in zip(out, rows):
        to[:len(v)] = v
    small = np.abs(out).max(initial=0) < 2**15
    return {"ids": ids.astype("<i8").tobytes(), "width": width, "cells": out.astype("<i2" if small else "<i8").tobytes(), "size": 2 if small else 8}


def unpacked(ids: bytes, width: int, cells: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, "<i8")
    return ids, np.frombuffer(cells, "<i2" if size == 2 else "<i8").astype(np.int64).reshape(len(ids), width)


BLOCK_SCHEMA = "ids binary, width int, cells binary, size int, longest double"


def blocks_of(rows: DataFrame, per_block: int) -> DataFrame:
    """(part, at, ids, width, cells, size, longest): vectors in order of descending length, per_block to a row; equal rows
    count once."""
    lengths = rows.withColumn("length", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, e: s + e.cast("double") * e.cast("double"))))
    tasks = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    ordered = lengths.repartitionByRange(int(tasks), F.desc("length"), F.col("id")).sortWithinPartitions(F.desc("length"), "id", "v")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def block(t: pd.DataFrame) -> dict:
            return packed(list(t["v"]), t["id"].to_numpy()) | {"longest": float(t["length"].iloc[0])}

        last: tuple[int, np.ndarray] | None = None
        for t in batches:
            ids, v = t["id"].tolist(), list(t["v"])
            new = np.ones(len(t), bool)
            for i, now in enumerate(zip(ids, v)):
                new[i] = last is None or now[0] != last[0] or not np.array_equal(now[1], last[1])
                last = now
            held.append(t[new])
            while sum(map(len, held)) >= per_block:
                t = pd.concat(held, ignore_index=True)
                yield pd.DataFrame([block(t[:per_block])])
                held = [t[per_block:]]
        t = pd.concat(held, ignore_index=True) if held else pd.DataFrame()
        if len(t):
            yield pd.DataFrame([block(t)])

    made = ordered.mapInPandas(run, BLOCK_SCHEMA)
    return written(made.withColumn("block", F.monotonically_increasing_id()), "blocks")


def best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best (id, score), the smaller id first among equal scores; equal pairs count once."""
    order = np.lexsort((ids, -scores))
    i, s = ids[order], scores[order]
    new = np.ones(len(order), bool)
    new[1:] = (i[1:] != i[:-1]) | (s[1:] != s[:-1])
    return order[new][:k]


def top_of_block(
    q: np.ndarray, q_ids: np.ndarray, least: np.ndarray, c: np.ndarray, c_ids: np.ndarray, turn: np.ndarray, k: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, id, score) of the k best candidates of one block for each query, without its own row; equal (id, score)
    count once.

    least is a score that the query's k-th best is known to reach. Candidates lie in order of descending length.
    """
    turned = []
    width = max(q.shape[1], c.shape[1])
    for x in (q, c):
        y = np.zeros((len(x), max(width, len(turn))))
        y[:, :x.shape[1]] = x
        turned.append(y[:, :len(turn)] @ turn)
    tq, tc = turned
    energy = np.cumsum((tq**2).sum(axis=0) + 1e-300)
    head = int(np.searchsorted(energy, HEAD_SHARE * energy[-1])) + 1 if len(energy) else 0
    length_q, length_c = np.sqrt((tq**2).sum(axis=1)), np.sqrt((tc**2).sum(axis=1))
    rest_q, rest_c = np.sqrt((tq[:, head:] ** 2).sum(axis=1)), np.sqrt((tc[:, head:] ** 2).sum(axis=1))
    wide_q, wide_c = np.zeros((len(q), width), np.int64), np.zeros((len(c), width), np.int64)
    wide_q[:, :q.shape[1]], wide_c[:, :c.shape[1]] = q, c
    exact_floats = width * np.abs(wide_q).max(initial=0) * float(np.abs(wide_c).max(initial=0)) < 2**52
    rows, ids, scores = [], [], []
    for r in range(len(q)):
        bar = float(least[r])
        # lengths descend: beyond this place no vector can reach the bar
        reach = len(c) if bar <= 0 else int(np.searchsorted(-length_c, -bar * (1 - SLACK) / max(length_q[r], 1e-300), "right"))
        slack = SLACK * length_q[r] * (length_c[0] if len(c) else 0) + 1e-6
        bound = tc[:reach, :head] @ tq[r, :head] + rest_c[:reach] * rest_q[r]
        open_ = np.flatnonzero(bound >= bar - slack)
        if len(open_) > 8 * k:
            # the k candidates of best bound give a bar of their own
            first = open_[np.argpartition(-bound[open_], 2 * k)[:2 * k + 1]]
            first = first[c_ids[first] != q_ids[r]]
            got = exact_scores(wide_c[first], wide_q[r], exact_floats)
            top = best_of(c_ids[first], got, k)
            if len(top) == k:
                bar = max(bar, float(got[top[-1]]))
                open_ = open_[bound[open_] >= bar - slack]
        open_ = open_[c_ids[open_] != q_ids[r]]
        score = exact_scores(wide_c[open_], wide_q[r], exact_floats)
        best = best_of(c_ids[open_], score, k)
        rows.append(np.full(len(best), r))
        ids.append(c_ids[open_[best]])
        scores.append(score[best])
    empty = np.zeros(0, np.int64)
    return tuple(np.concatenate([empty, *x]).astype(np.int64) for x in (rows, ids, scores))


def exact_scores(c: np.ndarray, q: np.ndarray, floats: bool) -> np.ndarray:
    """Whole inner products; through floats where all sums stay below 2^52."""
    return np.rint(c.astype(float) @ q.astype(float)).astype(np.int64) if floats else c @ q


def top_products(
    vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, id_column: str = "vec_id", vector_column: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row whose id is divisible by `every`, the k rows of largest inner
    product of floor(scale * x), its own id left out; ties go to the smaller id. Exact.

    Vectors that are null or hold a null or non-finite component take no part, nor do rows without id. Of vectors of
    unequal width the missing coordinates count as 0; an empty vector scores 0 with all. Rows that repeat an id are
    candidates each, and queries each: their results are merged and repeat no (id, score). Fewer than k candidates give
    all there are; an empty table gives an empty one; other columns are ignored.

    Queries and candidates come in blocks. Each query block meets the block of the longest vectors first, which gives
    every query a bar. Candidate blocks are grouped by the level of their longest vector (its logarithm, so there are at
    most some thousand levels, whatever the table), large levels are split by a hash, and a query block goes to the
    groups of the levels that its bars leave open.
    """
    rows = written(whole_vectors(vectors, id_column, vector_column, scale), "vectors")
    spark = rows.sparkSession
    turn = spark.sparkContext.broadcast(rotation(rows))
    candidates = blocks_of(rows, CANDIDATES_IN_BLOCK)
    queries = blocks_of(rows.where(F.col("id") % every == 0), QUERIES_IN_BLOCK)
    level = F.floor(F.log(F.greatest("longest", F.lit(1.0))) / np.log(LEVEL_STEP)).cast("int")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks_at = {r["level"]: min(parts, r["n"]) for r in candidates.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()}
    longest = candidates.orderBy("block").limit(1).collect()  # one block
    first = spark.sparkContext.broadcast(longest[0].asDict() if longest else None)

    def seed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each query block with its results from the block of longest vectors, its bars, and the groups still open."""
        for t in batches:
            out = []
            for x in t.to_dict("records"):
                q_ids, q = unpacked(x["ids"], x["width"], x["cells"], x["size"])
                c_ids, c = unpacked(*(first.value[n] for n in ("ids", "width", "cells", "size")))
                row, ids, scores = top_of_block(q, q_ids, np.full(len(q), -np.inf), c, c_ids, turn.value, k)
                bars = np.full(len(q), -np.inf)
                kth = np.flatnonzero(np.bincount(row, minlength=len(q)) == k)
                bars[kth] = np.minimum.reduceat(scores, np.searchsorted(row, kth)) if len(kth) == len(q) else [scores[row == r].min() for r in kth]
                length = np.sqrt((q.astype(float) ** 2).sum(axis=1))
                need = (bars / np.maximum(length, 1e-300)).min() * (1 - SLACK) if (bars > 0).all() else 0.0
                open_ = [(n, s) for n, count in blocks_at.items() if LEVEL_STEP ** (n + 1) * (1 + SLACK) >= need for s in range(count)]
                out.append(x | {
                    "bars": bars.tobytes(), "open": [{"level": n, "part": s} for n, s in open_],
                    "found": [{"query_id": i, "vec_id": j, "score": v} for i, j, v in zip(q_ids[row].tolist(), ids.tolist(), scores.tolist())],
                })
            yield pd.DataFrame(out, columns=[*t.columns, "bars", "open", "found"])

    seeded = written(queries.mapInPandas(
        seed, f"{BLOCK_SCHEMA}, block long, bars binary, open array<struct<level int, part int>>, "
        "found array<struct<query_id long, vec_id long, score long>>"), "seeds")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            for x in t.to_dict("records"):
                q_ids, q = unpacked(x["q_ids"], x["q_width"], x["q_cells"], x["q_size"])
                c_ids, c = unpacked(x["ids"], x["width"], x["cells"], x["size"])
                row, ids, scores = top_of_block(q, q_ids, np.frombuffer(x["bars"], "<f8"), c, c_ids, turn.value, k)
                yield pd.DataFrame({"query_id": q_ids[row], "vec_id": ids, "score": scores})

    groups = F.create_map(*(F.lit(x) for pair in blocks_at.items() for x in pair)) if blocks_at else F.lit(None).cast("map<int,int>")
    dealt = candidates.where(F.col("block") != F.lit(longest[0]["block"] if longest else None)).withColumn("level", level)
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("block"), groups[F.col("level")].cast("long")).cast("int"))
    asked = seeded.select(
        *(F.col(n).alias(f"q_{n}") for n in ("ids", "width", "cells", "size")), "bars", F.explode("open").alias("o")).select("*", "o.*").drop("o")
    rest = asked.join(dealt, ["level", "part"]).mapInPandas(search, "query_id long, vec_id long, score long")
    found = seeded.select(F.explode("found").alias("f")).select("f.*").union(rest).distinct()
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
