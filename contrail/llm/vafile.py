"""Op 3: exact top-k search by inner product with vector-approximation (VA) files.

Vectors are integers, floor(scale * x). They are written twice: exactly, a row each, and as the VA file, in which each
dimension of a block of vectors is cut into cells and a vector is a byte a dimension, its cell. A search scans the VA file
for lower and upper bounds of the scores: a first scan finds each query's k-th best lower bound over all blocks, a
second one the vectors whose upper bound reaches it. Only their exact vectors are read, in order of the bounds: first
the k of greatest upper bound, then those whose upper bound reaches the k-th score found so far, after which it is certain.

Blocks of queries meet blocks of cells (the queries are a stated set, so this is no join of all with all). A block
holds a number of components, so wide vectors make blocks of fewer rows. No vector or query is dropped or capped.

Vectors that are null or hold a null or non-finite component take no part; only vectors of equal dimension are
compared. Repeated vec_ids are rows of their own, and each query row gets its own ranking, but a query never meets a
row with its own id; a null vec_id is no query and ranks last among ties. No vectors or queries yield no rows. Other
columns are ignored, whatever their names.

Scores are exact at any size. Vectors with a component of `NARROW` or more, or of over `WIDE_DIM` components, are set apart, since
bounds in double precision could be wrong for them: their scores with all others are computed in blocks with Python's
integers, and each block's k best join the ranking. A score beyond 64 bits counts, and comes out, as the nearest 64-bit integer.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stage

BLOCK, QUERIES, CELLS = 1 << 19, 1 << 16, 64  # components in a block of vectors, in one of queries; cells a dimension
NARROW, WIDE_DIM = 1 << 20, 1 << 13  # so that scores of what is below fit in 53 bits
NO_ID = 2**63 - 1  # stands for a null id
WIDE = "q_no long, query_id long, vec_id long, score long"
VA_FILE = "dim int, block long, nos array<long>, ids array<long>, grid binary, low array<long>, width array<long>"


def integers(vectors: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """no (a number per row), id, dim and the integer vector v of the rows that take part, as a written table.

    Where wide holds, v is null and x, the scaled vector in double precision, stands for it.
    """
    good = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    x = F.transform(vec_col, lambda c: c.cast("double"))
    wide = F.exists(vec_col, lambda c: F.abs(c.cast("double") * F.lit(scale)) >= NARROW) | (F.size(vec_col) > WIDE_DIM)
    v = F.when(~wide, F.transform(vec_col, lambda c: F.floor(c.cast("double") * F.lit(scale))))
    rows = vectors.where(F.col(vec_col).isNotNull() & good)
    ids = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id")
    return stage(rows.select(F.monotonically_increasing_id().alias("no"), ids, F.size(vec_col).alias("dim"), v.alias("v"), F.when(wide, x).alias("x"), wide.alias("wide")), "va-exact")


def packs(rows: DataFrame, components: int) -> DataFrame:
    """Blocks of vectors of one dimension, of about so many components: dim, block and rows, a list of the other columns."""
    per_block = F.greatest(F.lit(1), F.floor(F.lit(components) / F.greatest(F.lit(1), F.col("dim"))))
    blocks = rows.groupBy("dim").agg(F.ceil(F.count("*") / F.first(per_block)).alias("blocks"))
    placed = rows.join(blocks, "dim").withColumn("block", F.pmod(F.xxhash64("no"), F.col("blocks")))
    return placed.groupBy("dim", "block").agg(F.collect_list(F.struct(*(c for c in rows.columns if c != "dim"))).alias("rows"))


def wide_scores(exact: DataFrame, asked: DataFrame, k: int, scale: float) -> DataFrame:
    """q_no, query_id, vec_id and score of each block's k best pairs in which one vector or both are wide."""

    def whole(row) -> list[int]:
        if row["x"] is None:
            return list(map(int, row["v"]))
        size = Fraction(scale)
        return [math.floor(c * scale) if abs(c * scale) < 2**1000 else math.floor(Fraction(c) * size) for c in row["x"]]

    def run(frames):
        for frame in frames:
            for row in frame.itertuples():
                vectors = list(map(whole, row.rows))
                for q in row.asked:
                    own, best = whole(q), []
                    for r, v in zip(row.rows, vectors, strict=True):
                        if r["id"] != q["id"] and (q["wide"] or r["wide"]):
                            score = sum(a * b for a, b in zip(own, v, strict=True))
                            best.append((-max(-(2**63), min(2**63 - 1, score)), r["id"]))
                    best = sorted(best)[:k]
                    yield pd.DataFrame({"q_no": [q["no"]] * len(best), "query_id": [q["id"]] * len(best), "vec_id": [b[1] for b in best], "score": np.array([-b[0] for b in best], np.int64)})

    def met(queries: DataFrame, vectors: DataFrame) -> DataFrame:
        blocks = packs(vectors, BLOCK).select("dim", "block", "rows")
        dealt = packs(queries, QUERIES).select("dim", F.col("block").alias("q_block"), F.col("rows").alias("asked"))
        return dealt.join(blocks, "dim").repartition("dim", "block", "q_block").mapInPandas(run, WIDE)

    return met(asked.where("wide"), exact).unionByName(met(asked.where("NOT wide"), exact.where("wide")))


def _matrix(rows, dim: int) -> np.ndarray:
    return np.array([r["v"] for r in rows], np.int64).reshape(len(rows), dim)


def approximate(vectors: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each component's cell, and by dimension the least component and the cells' width."""
    low, high = vectors.min(0), vectors.max(0)
    width = np.maximum(1, -(-(high - low + 1) // cells))
    return ((vectors - low) // width).astype(np.uint8), low, width


def va_file(exact: DataFrame, cells: int = CELLS) -> DataFrame:
    """The approximations of all exact vectors, as a written table of blocks."""

    def run(frames):
        for frame in frames:
            for row in frame.itertuples():
                grid, low, width = approximate(_matrix(row.rows, row.dim), cells)
                nos, ids = ([r[c] for r in row.rows] for c in ("no", "id"))
                yield pd.DataFrame({"dim": [row.dim], "block": [row.block], "nos": [nos], "ids": [ids], "grid": [grid.tobytes()], "low": [low], "width": [width]})

    return stage(packs(exact, BLOCK).mapInPandas(run, VA_FILE), "va-cells")


def bounds(block, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of all queries' scores with all vectors of a block of the VA file, by one product.

    A component is its cell's least value and at most width - 1 more.
    """
    grid = np.frombuffer(block.grid, np.uint8).reshape(len(block.ids), block.dim).astype(np.float64)
    low, width, q = np.asarray(block.low, np.float64), np.asarray(block.width, np.float64), queries.astype(np.float64)
    base = (q * width) @ grid.T + (q @ low)[:, None]
    return base + (np.minimum(q, 0) @ (width - 1))[:, None], base + (np.maximum(q, 0) @ (width - 1))[:, None]


def scan(va: DataFrame, queries: DataFrame, k: int, near: bool) -> DataFrame:
    """One scan of the VA file for all queries (no, id, dim, v and floor, what an upper bound must reach).

    q_no and bound: of each block its k best lower bounds; if near, q_no, no and bound: all vectors whose upper bound
    reaches the floor, with it.
    """
    asked = packs(queries, QUERIES).select("dim", F.col("block").alias("q_block"), F.col("rows").alias("asked"))
    pairs = va.select("dim", "block").join(asked, "dim").repartition("dim", "block", "q_block")

    def found(row) -> Iterator[pd.DataFrame]:
        ids, nos = np.asarray(row.ids, np.int64), np.asarray(row.nos, np.int64)
        for a in range(0, len(row.asked), 256):
            some = row.asked[a : a + 256]
            q_nos, q_ids, floors = (np.array([r[c] for r in some]) for c in ("no", "id", "floor"))
            lower, upper = bounds(row, _matrix(some, row.dim))
            own = q_ids[:, None] == ids[None, :]
            if near:
                q, v = np.nonzero((upper >= floors[:, None]) & ~own)
                yield pd.DataFrame({"q_no": q_nos[q], "no": nos[v], "bound": upper[q, v]})
            else:
                lower[own] = -np.inf
                best = np.partition(lower, len(ids) - k, axis=1)[:, len(ids) - k :] if len(ids) > k else lower
                rows = pd.DataFrame({"q_no": np.repeat(q_nos, best.shape[1]), "bound": best.ravel()})
                yield rows[np.isfinite(rows["bound"])]

    def run(frames):
        for frame in frames:
            for row in frame.itertuples():
                yield from found(row)

    return pairs.join(va, ["dim", "block"]).mapInPandas(run, "q_no long, no long, bound double" if near else "q_no long, bound double")


def kth(rows: DataFrame, value: str, k: int) -> DataFrame:
    """q_no and floor, the k-th greatest value of each query that has so many."""
    order = W.partitionBy("q_no").orderBy(F.desc(value))
    ranked = rows.select("q_no", value, F.row_number().over(order).alias("nth")).where(F.col("nth") <= k)
    return ranked.where(F.col("nth") == k).select("q_no", F.col(value).cast("double").alias("floor"))


def scored(pairs: DataFrame, exact: DataFrame, queries: DataFrame) -> DataFrame:
    """q_no, query_id, vec_id and the exact score of the pairs (q_no, no): only these vectors are read for it."""
    asked = queries.select(F.col("no").alias("q_no"), F.col("id").alias("query_id"), F.col("v").alias("q"))
    met = pairs.select("q_no", "no").join(exact.select("no", F.col("id").alias("vec_id"), "v"), "no").join(asked, "q_no")
    product = F.aggregate(F.zip_with("q", "v", lambda a, b: a * b), F.lit(0).cast("long"), lambda s, x: s + x)
    return met.select("q_no", "query_id", "vec_id", product.alias("score"))


def candidates(va: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """q_no, no, bound and nth (by falling bound) of the vectors that can be among each query's k best."""
    floors = kth(scan(va, asked.withColumn("floor", F.lit(float("-inf"))), k, near=False), "bound", k)
    floored = asked.join(floors, asked["no"] == floors["q_no"], "left").drop("q_no").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    rows = scan(va, floored, k, near=True)
    return stage(rows.withColumn("nth", F.row_number().over(W.partitionBy("q_no").orderBy(F.desc("bound"), "no"))), "va-candidates")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 64.0, cells: int = CELLS) -> DataFrame:
    """query_id, rank, vec_id and score: the k best vectors of each query row, ties to the smaller vec_id."""
    exact = integers(vectors, id_col, vec_col, scale)
    asked = integers(queries.where(F.col(id_col).isNotNull()), id_col, vec_col, scale)
    if cells > 256:
        raise ValueError("a cell is a byte, so there are at most 256 a dimension")
    narrow, narrow_asked = (t.where("NOT wide").drop("x", "wide") for t in (exact, asked))
    near = candidates(va_file(narrow, cells), narrow_asked, k)
    first = stage(scored(near.where(F.col("nth") <= k), narrow, narrow_asked), "va-first")
    rest = near.where(F.col("nth") > k).join(kth(first, "score", k), "q_no").where("bound >= floor")
    rows = first.unionByName(scored(rest, narrow, narrow_asked))
    if not exact.where("wide").isEmpty() or not asked.where("wide").isEmpty():
        rows = rows.unionByName(wide_scores(exact, asked, k, scale))
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy("q_no").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.nullif("vec_id", F.lit(NO_ID)).alias("vec_id"), "score")


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.v, v.v)::BIGINT AS score FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20
"""
