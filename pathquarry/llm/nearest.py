"""Approximate nearest neighbours by randomly rotated one-bit codes.

Vectors are scaled to length one and assigned to the nearest of a few hundred
centroids.  The residual's direction is rotated at random and kept as one bit a
dimension, packed, with scalars that turn agreement of bits into an unbiased
estimate of the inner product and into a bound on its error.  A query's residual
is rotated too and rounded to eight bits a dimension; its inner product with a
code is a weighted sum of the bits that the code shares with each of its eight
bit planes.  In each cell a query visits, it reranks, by exact cosine on the
original vectors, every vector whose upper bound reaches the fifth best lower
bound, or the query's fifth best among a bounded sample where that is higher.

A query visits all cells but those that cannot hold a neighbour: no vector of a
cell is nearer than the cell's centre less its radius, as angles.  (On vectors
without clusters the nearest half of 113 cells held 0.93 of the true neighbours
of check_l and 0.88 of check_s, so no share of the cells is left out by default;
a lower probe_share reads less.)  Codes travel with their vectors, once for each
block, since a vector is reranked for many queries.

Vectors that are null, zero, or hold null or non-finite components take no
part.  Vectors of different lengths are never compared.  Very large and very
small components are scaled by powers of two.  Ties go to the smaller vec_id; a
query's own vec_id is no candidate.  Repeated rows are one; of several vectors
under one vec_id the best counts, for neighbours and for queries.  Fewer than
five candidates: all of them.  Empty tables give empty results; other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import Scratch, frugal, shuffle_partitions

#: Centroids at most, and vectors for each; floats of the sample that centroids are fitted on, at most (rows chosen by hash of the id).
CENTROIDS, PER_CELL, SAMPLE_FLOATS = 1024, 2048, 4_000_000
#: Vectors of the sample that give a query its first bar, at most.
BAR_SAMPLE = 4096
#: Vectors in a block of a cell at most; a larger cell has several, visited apart.
BLOCK = 16_384
#: Width of the error bound in standard deviations.
EPSILON = 2.5
TOP, EVERY, SEED = 5, 50, 20_240_101


def usable(vectors: DataFrame) -> DataFrame:
    v = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(fine & F.exists("v", lambda x: x != 0))


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two, so that squares neither overflow nor vanish; their cosines stay the same to the last bit."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _words(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    packed = np.packbits(bits, axis=-1)
    pad = -packed.shape[-1] % 8
    return np.ascontiguousarray(np.pad(packed, [(0, 0)] * (packed.ndim - 1) + [(0, pad)])).view(np.uint64)


def fit(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Centroids by Lloyd's rounds on the sample."""
    rng = np.random.default_rng(SEED)
    distinct = np.unique(sample, axis=0)
    centres = distinct[rng.permutation(len(distinct))[:k]]
    for _ in range(rounds):
        nearest = np.argmax(sample @ centres.T - (centres * centres).sum(1) / 2, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        n = np.bincount(nearest, minlength=len(centres))[:, None]
        centres = np.where(n > 0, sums / np.maximum(n, 1), centres)
    return centres


def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


class Codes:
    """One block of a cell: packed bits, correction scalars and original vectors."""

    def __init__(self, ids, vectors, centre, turn):
        self.ids, self.vectors, self.centre, self.turn = ids, _scaled(vectors), centre, turn
        dim = vectors.shape[1]
        rest = _unit(vectors) - centre
        self.far = np.sqrt((rest * rest).sum(1))
        direction = rest / np.where(self.far > 0, self.far, 1)[:, None]
        turned = direction @ turn.T
        self.bits = _words(turned > 0)
        self.ones = np.bitwise_count(self.bits).sum(axis=1, dtype=np.int64)
        self.agree = np.maximum(np.abs(turned).sum(1) / np.sqrt(dim), 1e-6)  # inner product of the code and what it stands for
        self.lean = direction @ centre
        self.dim = dim
        self.norm = np.sqrt((self.vectors * self.vectors).sum(1))
        self.first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))  # ids are in order

    def agreement(self, turned: np.ndarray):
        """Estimated inner products of a rotated query with the codes, and the step it was rounded to."""
        low, high = turned.min(), turned.max()
        step = max((high - low) / 255, 1e-30)
        rounded = np.rint((turned - low) / step).astype(np.uint8)
        planes = _words((rounded >> np.arange(8, dtype=np.uint8)[:, None]) & 1)
        shared = np.zeros(len(self.bits), dtype=np.int64)
        for p, plane in enumerate(planes):
            shared += np.bitwise_count(self.bits & plane).sum(axis=1, dtype=np.int64) << p
        return (2 * (low * self.ones + step * shared) - turned.sum()) / np.sqrt(self.dim), step

    def search(self, query_ids, queries, bars, top: int):
        """(query_id, vec_id, score) of each query's best in this block; bars: scores that its `top` best reach anyway."""
        queries = _scaled(queries)
        unit = _unit(queries)
        rest = unit - self.centre
        away, turned, lean = np.sqrt((rest * rest).sum(1)), rest @ self.turn.T, unit @ self.centre
        spread = self.far * np.sqrt(np.maximum(0, 1 - self.agree**2)) / self.agree * EPSILON / np.sqrt(max(1, self.dim - 1))
        out = []
        for i, own in enumerate(query_ids):
            inner, step = self.agreement(turned[i])
            estimate = lean[i] + self.far * (self.lean + inner / self.agree)
            error = away[i] * spread + EPSILON * step / np.sqrt(6) * self.far / self.agree + 1e-6
            other = self.ids != own
            low = np.where(other, estimate - error, -np.inf)
            each = np.maximum.reduceat(low, self.first)  # of each vec_id
            bar = max(bars[i], np.partition(each, -top)[-top] if len(each) > top else -np.inf)
            pick = np.flatnonzero(other & (estimate + error >= bar))
            score = (self.vectors[pick] * queries[i]).sum(1) / (self.norm[pick] * np.sqrt((queries[i] * queries[i]).sum()))
            best = np.lexsort((self.ids[pick], -score))
            best = best[np.sort(np.unique(self.ids[pick][best], return_index=True)[1])[:top]]
            out += [(own, v, s) for v, s in zip(self.ids[pick][best], score[best], strict=True)]
        return out


def search(vectors: DataFrame, every: int = EVERY, top: int = TOP, probe_share: float = 1.0) -> DataFrame:
    """query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    result = "query_id long, rank int, vec_id long, score double"
    scratch = Scratch(spark)
    rows = scratch.put(usable(vectors).dropDuplicates(["vec_id", "v"]).withColumn("dim", F.size("v")))
    dims = [(r.dim, r.n) for r in rows.groupBy("dim").agg(F.count("*").alias("n")).orderBy("dim").collect()]
    parts = [_search_dim(scratch, rows.where(F.col("dim") == d), d, n, every, top, probe_share) for d, n in dims]
    if not parts:
        return spark.createDataFrame([], result)
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _search_dim(scratch: Scratch, rows: DataFrame, dim: int, n: int, every: int, top: int, probe_share: float) -> DataFrame:
    spark = rows.sparkSession
    k = max(1, min(CENTROIDS, n // PER_CELL))
    size = max(1, min(n, 64 * k, SAMPLE_FLOATS // dim))
    sample = rows.select("v", "vec_id").orderBy(F.xxhash64("vec_id"), "vec_id").limit(size).toArrow()
    known, turn = _unit(_matrix(sample.column("v"))), rotation(dim)
    centres = fit(known, k)
    known_ids, at = np.unique(sample.column("vec_id").to_numpy(), return_index=True)
    known_ids, known = known_ids[:BAR_SAMPLE], known[at[:BAR_SAMPLE]]
    probes = max(min(8, len(centres)), round(probe_share * len(centres)))
    half = (centres * centres).sum(1) / 2
    length = np.sqrt((centres * centres).sum(1))
    axes = centres / np.where(length > 0, length, 1)[:, None]

    def assign(batches):
        for b in batches:
            if b.num_rows:
                unit = _unit(_matrix(b.column("v")))
                cell = np.argmax(unit @ centres.T - half, axis=1)
                angle = np.arccos(np.clip((unit * axes[cell]).sum(1), -1, 1))
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), b.column("vec_id"), b.column("v"), pa.array(angle)], ["cell", "vec_id", "v", "angle"])

    placed = scratch.put(rows.select("vec_id", "v").mapInArrow(frugal(assign), "cell int, vec_id long, v array<double>, angle double"))
    counts, distinct, radius = np.zeros(len(centres), dtype=np.int64), np.zeros(len(centres), dtype=np.int64), np.zeros(len(centres))
    for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.countDistinct("vec_id").alias("ids"), F.max("angle").alias("angle")).collect():  # a row for each centroid at most
        counts[r.cell], distinct[r.cell], radius[r.cell] = r.n, r.ids, r.angle
    radius = np.where(length > 0, radius + 1e-6, np.pi)
    blocks = np.maximum(1, -(-counts // BLOCK))
    many = F.array(*[F.lit(int(x)) for x in blocks])
    held = placed.withColumn("block", F.pmod(F.xxhash64("vec_id"), many[F.col("cell")]).cast("int")).select("cell", "block", F.lit(0).alias("query"), "vec_id", "v", F.lit(0.0).alias("bar"))

    def first_bar(ids, unit):
        """The score that the `top` best of the sample reach, for each query."""
        if len(known_ids) <= top:
            return np.full(len(ids), -np.inf)
        score = np.where(known_ids == ids[:, None], -np.inf, unit @ known.T)
        return np.partition(score, -top, axis=1)[:, -top] - 1e-9

    def visit(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                unit = _unit(_matrix(part.column("v")))
                bars = first_bar(part.column("vec_id").to_numpy(zero_copy_only=False), unit)
                near = np.argsort(half - unit @ centres.T, axis=1, kind="stable")
                apart = np.arccos(np.clip(unit @ axes.T, -1, 1)) - radius
                useful = np.cos(np.maximum(apart, 0)) >= bars[:, None]
                who, cell, block = [], [], []
                for i, order in enumerate(near):
                    enough = int(np.searchsorted(np.cumsum(distinct[order]), top + 1)) + 1  # cells that hold that many
                    for c in order[: max(probes, enough)]:
                        if counts[c] and useful[i, c]:
                            who += [i] * int(blocks[c])
                            cell += [c] * int(blocks[c])
                            block += range(int(blocks[c]))
                for at in range(0, len(who), 4096):
                    w = pa.array(who[at : at + 4096], pa.int64())
                    columns = [pa.array(cell[at : at + 4096], pa.int32()), pa.array(block[at : at + 4096], pa.int32()), pa.array([1] * len(w), pa.int32()), part.column("vec_id").take(w), part.column("v").take(w), pa.array(bars).take(w)]
                    yield pa.RecordBatch.from_arrays(columns, ["cell", "block", "query", "vec_id", "v", "bar"])

    asked = rows.where(F.col("vec_id") % every == 0).select("vec_id", "v").mapInArrow(frugal(visit), "cell int, block int, query int, vec_id long, v array<double>, bar double")
    both = held.unionByName(asked).repartition(shuffle_partitions(spark), "cell", "block").sortWithinPartitions("cell", "block", "query", "vec_id")

    def scan(batches):
        at, ids, vectors, codes = None, [], [], None
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "block", "query")], axis=1)
            edges = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1
            own, v, bars, out = b.column("vec_id").to_numpy(zero_copy_only=False), _matrix(b.column("v")), b.column("bar").to_numpy(zero_copy_only=False), []
            for lo, hi in zip([0, *edges], [*edges, len(keys)], strict=True):
                if (cell := tuple(keys[lo, :2])) != at:
                    at, ids, vectors, codes = cell, [], [], None
                if keys[lo, 2] == 0:
                    ids.append(own[lo:hi].copy())
                    vectors.append(v[lo:hi].copy())
                elif ids:
                    codes = codes or Codes(np.concatenate(ids), np.concatenate(vectors), centres[at[0]], turn)
                    out += codes.search(own[lo:hi], v[lo:hi], bars[lo:hi], top)
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], ["query_id", "vec_id", "score"])

    return both.mapInArrow(frugal(scan), "query_id long, vec_id long, score double")
