"""Hard negatives: rows of another label that score nearly as high as a positive of the same.

A score is the integer inner product of two vectors. Anchors are cut into blocks, and each block is
spanned by a minimum tree over the distances of its vectors. A candidate's score at an anchor is its
score at the tree's parent give or take the edge times the candidate's norm (Cauchy-Schwarz on the
difference of the two anchors), and the bounds pass down the tree. Only where the bounds overlap a
window of scores that can matter is the score itself computed, which makes the bounds below it
tight again. Bounds only decide what is computed; results are exact.

Two passes: the best positives of every anchor, whose window is what beats the last of the best so
far; then the negatives in the windows below these positives.

A task compares one block of anchors with one slice of candidates, both of bounded size, and
returns at most k rows an anchor (or an anchor and positive). The blocks and slices meet in a
shuffle, nothing is broadcast and nothing passes through the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import stage

SCALE = 256
BLOCK_ROWS = 2048  # anchors of a tree, about
SLICE_ROWS = 4096  # candidates of a task, about
CHUNK = 1024  # candidates whose bounds are held at once
LONGEST = float(1 << 31)  # norm; inner products of shorter vectors are longs


class Anchors(NamedTuple):
    """A block in tree order: parents come first; the root has parent -1 and its norm as edge."""
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    parents: np.ndarray
    edges: np.ndarray


def spanning_tree(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in the order a minimum spanning tree takes them, parents (places in that order), edges.

    The tree grows from the shortest vector, whose edge leads to the origin.
    """
    v = vectors.astype(np.float64)
    n = len(v)
    order, parents, edges = np.zeros(n, np.int64), np.full(n, -1), np.zeros(n)
    near = np.sqrt((v * v).sum(axis=1))
    order[0] = np.argmin(near)
    edges[0] = near[order[0]]
    near, via = np.full(n, np.inf), np.zeros(n, np.int64)
    out = np.ones(n, bool)
    for place in range(n):
        if place:
            order[place] = np.argmin(np.where(out, near, np.inf))
            parents[place], edges[place] = via[order[place]], near[order[place]]
        at = order[place]
        out[at] = False
        apart = np.sqrt(((v - v[at]) ** 2).sum(axis=1))
        closer = apart < near
        near[closer], via[closer] = apart[closer], place
    return order, parents, edges


def scores_in_windows(anchors: Anchors, vectors: np.ndarray, norms: np.ndarray,
                      wanted: Callable[[int, np.ndarray, np.ndarray], np.ndarray],
                      take: Callable[[int, np.ndarray, np.ndarray], None]) -> int:
    """Walk the tree for one chunk of candidates; the number of scores computed.

    `wanted(anchor, low, high)` marks the candidates whose bounds overlap the anchor's window;
    `take(anchor, rows, scores)` gets these with their scores.
    """
    longest = float(np.sqrt((anchors.vectors.astype(np.float64) ** 2).sum(axis=1)).max(initial=0))
    exact = longest * float(norms.max(initial=0)) < 2.0 ** 52  # doubles then add up exactly
    kind = np.float64 if exact else np.int64
    a, c = anchors.vectors.astype(kind), vectors.astype(kind)
    low = np.zeros((len(a), len(c)))
    high = np.zeros((len(a), len(c)))
    computed = 0
    for k in range(len(a)):
        reach = anchors.edges[k] * norms * (1 + 1e-9) + 0.5
        if (p := anchors.parents[k]) >= 0:
            reach += 1e-9 * np.maximum(np.abs(low[p]), np.abs(high[p]))
            low[k], high[k] = low[p] - reach, high[p] + reach
        else:
            low[k], high[k] = -reach, reach
        rows = np.flatnonzero(wanted(k, low[k], high[k]))
        if len(rows):
            found = c[rows] @ a[k]
            low[k, rows] = high[k, rows] = found
            take(k, rows, found.astype(np.int64))
            computed += len(rows)
    return computed


class Best:
    """The k rows with the highest scores seen so far; ties go to the smaller id."""

    def __init__(self, k: int):
        self.k, self.ids, self.scores = k, np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate((self.ids, ids)), np.concatenate((self.scores, scores))
        order = np.lexsort((ids, -scores))[:self.k]
        self.ids, self.scores = ids[order], scores[order]

    @property
    def least(self) -> float:
        return float(self.scores[-1]) if len(self.scores) == self.k else -np.inf


def union(windows: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint windows that cover the same scores."""
    out: list[tuple[int, int]] = []
    for low, high in sorted(windows):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def window_below(score: int, percent: int) -> tuple[int, int]:
    """The scores n with percent * score <= 100 * n <= 100 * score; first above last if none."""
    return -(-percent * score // 100), score


def scaled(vector: str, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component, as longs."""
    return F.transform(F.col(vector), lambda x: F.floor(F.lit(scale) * x.cast("double")))


def candidates(rows: DataFrame, anchor: Column, id_col: str, vector_col: str,
               label_col: str) -> DataFrame:
    """(id, label, v, dims, anchor) of the rows that take part, one for each id."""
    usable = rows.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"),
        F.col(vector_col).alias("vector"), F.coalesce(anchor, F.lit(False)).alias("anchor")
    ).where("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL").where(
        F.coalesce(F.forall("vector", lambda x: x.isNotNull()
                            & (F.abs(x.cast("double")) < LONGEST)), F.lit(False)))
    whole = usable.select("id", "anchor", "label", scaled("vector").alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    one = whole.where(norm < LONGEST).groupBy("id").agg(
        F.max("anchor").alias("anchor"), F.min(F.struct("label", "v")).alias("r"))
    return one.select("id", "anchor", "r.label", "r.v", F.size("r.v").alias("dims"))


def _matrix(table: pa.Table, name: str, dims: int) -> np.ndarray:
    return table.column(name).combine_chunks().flatten().to_numpy().reshape(len(table), dims)


def _with_trees(anchors: DataFrame) -> DataFrame:
    """Anchors with their block's tree: (dims, block, id, label, v, place, parent, edge)."""
    def run(table: pa.Table) -> pa.Table:
        order, parents, edges = spanning_tree(_matrix(table, "v", table.column("dims")[0].as_py()))
        table = table.select(["dims", "block", "id", "label", "v"]).take(pa.array(order))
        for name, values in (("place", np.arange(len(order))), ("parent", parents),
                             ("edge", edges)):
            table = table.append_column(name, pa.array(values))
        return table

    kind = anchors.schema["label"].dataType.simpleString()
    return anchors.groupBy("dims", "block").applyInArrow(
        run, f"dims int, block int, id long, label {kind}, v array<bigint>, place long, "
             "parent long, edge double")


def _read(left: pa.Table, right: pa.Table) -> tuple[Anchors, tuple]:
    """The anchors of a task in tree order; ids, labels, vectors and norms of its candidates.

    Labels become numbers that are equal on both sides where the labels are.
    """
    dims = left.column("dims")[0].as_py()
    left = left.sort_by("place")
    labels = pa.chunked_array([*left.column("label").chunks, *right.column("label").chunks])
    codes = labels.combine_chunks().dictionary_encode().indices.to_numpy()
    anchors = Anchors(left.column("id").to_numpy(), codes[:len(left)], _matrix(left, "v", dims),
                      left.column("parent").to_numpy(), left.column("edge").to_numpy())
    vectors = _matrix(right, "v", dims)
    norms = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
    return anchors, (right.column("id").to_numpy(), codes[len(left):], vectors, norms)


def _chunks(rows: tuple):
    for at in range(0, len(rows[0]), CHUNK):
        yield tuple(x[at:at + CHUNK] for x in rows)


def _positives(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[Best] = []
        ids = np.empty(0, np.int64)
        if len(left) and len(right):
            anchors, rows = _read(left, right)
            ids = anchors.ids
            out = [Best(k) for _ in anchors.ids]
            for cid, label, vectors, norms in _chunks(rows):
                scores_in_windows(
                    anchors, vectors, norms,
                    lambda a, low, high: (high >= out[a].least) & (label == anchors.labels[a])
                    & (cid != anchors.ids[a]),
                    lambda a, at, found: out[a].add(cid[at], found))
        return pa.table({
            "anchor_id": np.repeat(ids, [len(b.ids) for b in out]),
            "positive_id": np.concatenate([np.empty(0, np.int64), *(b.ids for b in out)]),
            "positive_score": np.concatenate([np.empty(0, np.int64), *(b.scores for b in out)])})

    return run


def _negatives(k: int, percent: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        best: dict[tuple[int, int], tuple[Best, int, int]] = {}
        names: list[tuple[int, int, int]] = []
        if len(left) and len(right):
            anchors, rows = _read(left, right)
            positives = left.sort_by("place").column("positives").to_pylist()
            windows = []
            for a, found in enumerate(positives):
                own = [(i, window_below(p["positive_score"], percent)) for i, p in enumerate(found)]
                own = [(i, w) for i, w in own if w[0] <= w[1]]
                windows.append(union([w for _, w in own]))
                for i, w in own:
                    best[a, i] = (Best(k), *w)
            for cid, label, vectors, norms in _chunks(rows):
                def wanted(a, low, high):
                    hit = np.zeros(len(low), bool)
                    for first, last in windows[a]:
                        hit |= (high >= first) & (low <= last)
                    return hit & (label != anchors.labels[a])

                def take(a, at, found):
                    for i in range(len(positives[a])):
                        if (a, i) in best:
                            kept, first, last = best[a, i]
                            inside = (found >= max(first, kept.least)) & (found <= last)
                            if inside.any():
                                kept.add(cid[at][inside], found[inside])

                scores_in_windows(anchors, vectors, norms, wanted, take)
            names = [(int(anchors.ids[a]), positives[a][i]["positive_id"],
                      positives[a][i]["positive_score"]) for a, i in best]
        counts = [len(b.ids) for b, _, _ in best.values()]
        name = [np.repeat(np.array([n[x] for n in names], np.int64), counts) for x in range(3)]
        return pa.table({
            "anchor_id": name[0], "positive_id": name[1], "positive_score": name[2],
            "negative_id": np.concatenate([np.empty(0, np.int64),
                                           *(b.ids for b, _, _ in best.values())]),
            "negative_score": np.concatenate([np.empty(0, np.int64),
                                              *(b.scores for b, _, _ in best.values())])})

    return run


def _meet(anchors: DataFrame, rows: DataFrame, blocks: int, slices: int, run, schema: str):
    """`run` on every block of anchors with every slice of rows."""
    def numbers(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    tile = ["dims", "block", "slice"]
    left = anchors.withColumn("slice", numbers(slices)).groupBy(*tile)
    right = rows.select("id", "label", "v", "dims", "slice",
                        numbers(blocks).alias("block")).groupBy(*tile)
    return left.cogroup(right).applyInArrow(run, schema)


def mine(rows: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding",
         label_col: str = "label", positives: int = 5, negatives: int = 5, percent: int = 80,
         block_rows: int = BLOCK_ROWS, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows where `anchor` holds. An anchor's positives are its first `positives`
    other rows of the same label, by score and then by smaller id. For each, the first `negatives`
    rows of another label come back whose score is between `percent` of the positive's and the
    positive's, ranked from 1; all of them, if fewer.

    Ids are whole numbers. Rows with a null id, label, vector or component take no part, nor do
    those with a component that is not finite or whose scaled norm is 2**31 or more, as their
    scores need not fit into a long. Rows that repeat an id are one row, that with the smallest
    label and vector. Vectors of different lengths are not compared. No rows give no rows.
    """
    found = stage(candidates(rows, anchor, id_col, vector_col, label_col), "vectors")
    n = found.agg(F.count("*").alias("rows"), F.count_if("anchor").alias("anchors")).first()
    blocks = max(1, ceil(n.anchors / block_rows))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slices = max(1, ceil(n.rows / slice_rows), min(ceil(n.rows / 512), tasks))

    def part(salt: str, count: int) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(count)).cast("int")

    sliced = found.select("id", "label", "v", "dims", part("slice", slices).alias("slice"))
    trees = stage(_with_trees(found.where("anchor").withColumn("block", part("block", blocks))),
                  "trees")
    near = _meet(trees, sliced, blocks, slices, _positives(positives),
                 "anchor_id long, positive_id long, positive_score long")
    place = F.row_number().over(W.partitionBy("anchor_id").orderBy(
        F.desc("positive_score"), "positive_id"))
    best = stage(near.withColumn("_place", place).where(F.col("_place") <= positives)
                 .groupBy("anchor_id").agg(F.collect_list(F.struct(
                     "positive_id", "positive_score")).alias("positives")), "positives")
    asked = trees.join(best, trees.id == best.anchor_id, "left").select(
        *trees.columns, F.coalesce("positives", F.array().cast(best.schema["positives"].dataType))
        .alias("positives"))
    hard = _meet(asked, sliced, blocks, slices, _negatives(negatives, percent),
                 "anchor_id long, positive_id long, positive_score long, negative_id long, "
                 "negative_score long")
    rank = F.row_number().over(W.partitionBy("anchor_id", "positive_id").orderBy(
        F.desc("negative_score"), "negative_id"))
    return hard.withColumn("rank", rank).where(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS other_id, a.label = c.label AS alike,
    CAST(coalesce(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * c.v[i])), 0)
         AS BIGINT) AS score
  FROM e a JOIN e c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id AND len(a.v) = len(c.v)),
p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank,
  other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT alike
  AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id)
QUALIFY row_number() OVER w <= 5"""
