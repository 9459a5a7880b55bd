"""Exact top-k inner products: candidates by descending length, partial sums in rotated space, Cauchy-Schwarz for the rest.

Vectors become integers, so scores are exact. The matrix of all vectors' second
moments gives its right singular directions. In a task, candidates come in
blocks by descending length. A query whose length times a block's longest is
below its k-th score so far is done there. For the others the leading rotated
coordinates give a partial sum, and the lengths of what is left bound the rest;
only pairs whose bound reaches the k-th score get an exact score. The longest
vectors of all give each query a first k-th score. Queries go in blocks, one
after the other, each result written before the next block is sent; candidates
that are too short for every query of a block are not read for it.
"""

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from layoutcheck.llm.nearvec import _adder, _moments, _rows
from layoutcheck.llm.shared import Scratch, partitions, small_batches

SCALE = 256
#: Rotated coordinates in the partial sums, of which each is tested against the bound.
LEVELS = (16, 32)
#: Candidates in a block; longest candidates that give first bounds; queries that are sent to all tasks at once.
BLOCK, HEAD, QUERIES = 1024, 2048, 8192

_CLEAN = "id long, dim int, v binary, norm double"


def _scaler(scale: int):
    def run(batches):
        for batch in batches:
            ids, dims, out, norms = [], [], [], []
            for i, v in zip(batch.column("id").to_pylist(), batch.column("v")):
                if not v.is_valid or v.values.null_count:
                    continue
                x = np.asarray(v.values).astype(np.float64)
                if not np.isfinite(x).all():
                    continue
                x = np.floor(scale * x)
                if not np.isfinite(x).all():
                    continue
                ids.append(i)
                dims.append(len(x))
                out.append(x.tobytes())
                norms.append(float(np.sqrt(x @ x)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(out, pa.binary()), pa.array(norms, pa.float64())], ["id", "dim", "v", "norm"])

    return run


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers; by ever larger integers as they need it, held at the ends of 64 bits."""
    if not len(a):
        return np.zeros(0, np.int64)
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if most < 2**53:
        return np.einsum("ij,ij->i", a, b).astype(np.int64)
    if most < 2**62 and max(np.abs(a).max(), np.abs(b).max()) < 2**62:
        return np.einsum("ij,ij->i", a.astype(np.int64), b.astype(np.int64))
    return np.array([min(max(sum(int(x) * int(y) for x, y in zip(p, q)), -(2**63)), 2**63 - 1) for p, q in zip(a, b)], np.int64)


class _Best:
    """The k best (score, id) of each query so far, ties to smaller ids."""

    def __init__(self, n: int, k: int):
        self.k, self.query, self.score, self.id = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.kth = np.full(n, -np.inf)

    def add(self, query, score, ids):
        query, score, ids = np.concatenate((self.query, query)), np.concatenate((self.score, score)), np.concatenate((self.id, ids))
        order = np.lexsort((ids, -score.astype(np.float64), query)) if not len(score) or np.abs(score.astype(np.float64)).max() < 2**53 else np.array(sorted(range(len(score)), key=lambda i: (query[i], -int(score[i]), ids[i])))
        query, score, ids = query[order], score[order], ids[order]
        start = np.searchsorted(query, query, "left")
        nth = np.arange(len(query)) - start
        keep = nth < self.k
        self.query, self.score, self.id = query[keep], score[keep], ids[keep]
        last = nth == self.k - 1
        self.kth[query[last]] = np.maximum(self.kth[query[last]], score[last])


@dataclass
class Turned:
    """Vectors by descending length, rotated, with the lengths of what is left after each level of coordinates."""

    ids: np.ndarray
    x: np.ndarray
    turned: np.ndarray
    norm: np.ndarray
    rest: list[np.ndarray]

    @classmethod
    def of(cls, ids: np.ndarray, x: np.ndarray, axes: np.ndarray) -> "Turned":
        turned = x @ axes
        squares = turned**2
        rest = [np.sqrt(squares[:, end:].sum(1)) for end in LEVELS if end < x.shape[1]]
        return cls(ids, x, turned, np.sqrt((x**2).sum(1)), rest)

    def part(self, at: slice) -> "Turned":
        return Turned(self.ids[at], self.x[at], self.turned[at], self.norm[at], [r[at] for r in self.rest])


def scan(best: _Best, q: Turned, c: Turned) -> None:
    """One block of candidates by descending length against the queries."""
    need = best.kth - 0.5 - 1e-9 * q.norm * c.norm[0]  # scores are whole numbers; the rest is for rounding
    own, cols = np.flatnonzero(q.norm * c.norm[0] >= need), np.arange(len(c.ids))
    total, start = np.zeros((len(own), len(cols))), 0
    for level, end in enumerate([end for end in LEVELS if end < q.x.shape[1]] + [q.x.shape[1]]):
        if not len(own) or not len(cols):
            return
        total += q.turned[own, start:end] @ c.turned[cols, start:end].T
        bound = total + np.outer(q.rest[level][own], c.rest[level][cols]) if level < len(q.rest) else total
        hit = bound >= need[own][:, None]
        rows, columns = hit.any(1), hit.any(0)
        own, cols, hit, total, start = own[rows], cols[columns], hit[rows][:, columns], total[rows][:, columns], end
    p, k = np.nonzero(hit)
    p, k = own[p], cols[k]
    other = q.ids[p] != c.ids[k]
    p, k = p[other], k[other]
    for low in range(0, len(p), 1 << 16):
        part = slice(low, low + (1 << 16))
        best.add(p[part], exact(q.x[p[part]], c.x[k[part]]), c.ids[k[part]])


def _searcher(dim: int, k: int, axes: np.ndarray, sent):
    def run(batches):
        ids_q, queries, kth = sent.value
        q, best = Turned.of(ids_q, queries, axes), _Best(len(ids_q), k)
        best.kth[:] = kth
        for batch in batches:
            order = np.argsort(-np.asarray(batch.column("norm")), kind="stable")
            c = Turned.of(np.asarray(batch.column("id"))[order], _rows(batch.column("v"), dim)[order], axes)
            for low in range(0, len(order), BLOCK):
                scan(best, q, c.part(slice(low, low + BLOCK)))
        good = best.score >= kth[best.query]
        yield pa.RecordBatch.from_arrays([pa.array(ids_q[best.query[good]]), pa.array(best.id[good]), pa.array(best.score[good])], ["query_id", "vec_id", "score"])

    return run


def least_length(best: _Best, q: Turned) -> float:
    """The length below which no candidate reaches the k-th score so far of any of the queries."""
    if not len(q.ids) or not q.norm.all():
        return 0.0  # a query of no length scores 0 with everything
    return max(0.0, float(((best.kth - 0.5) / q.norm).min()) * (1 - 1e-6))  # the rest is for rounding


def top_inner_products(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best; ties to the smaller vec_id.

    Queries are the rows whose id is divisible by ``every``; candidates are all
    rows whose id is another. Vectors that are null or hold null or non-finite
    components, or get one by scaling, and rows with a null id take no part;
    vectors of different lengths do not meet. An id that is repeated as a query
    asks once, with its least vector by bytes; as candidates repeated rows all
    count. Scores beyond 64 bits are held at the ends. Other columns are
    ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    small_batches(spark, 4096)
    scratch = Scratch(spark, "inner-products")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").alias("v")).where("id IS NOT NULL")
    clean = scratch.keep(rows.mapInArrow(_scaler(scale), _CLEAN), "clean")
    found, schema = [], "query_id long, vec_id long, score long"
    for (dim,) in clean.where("dim > 0").select("dim").distinct().collect():  # one or a few lengths
        own = clean.where(F.col("dim") == dim)
        (moments,) = own.select("v").mapInArrow(_moments(dim), "m binary").groupBy().applyInArrow(_adder, "m binary").first()
        axes = np.ascontiguousarray(np.linalg.eigh(np.frombuffer(moments, np.float64).reshape(dim, dim))[1][:, ::-1])
        ordered = scratch.keep(own.repartitionByRange(partitions(spark), F.desc("norm"), "id").sortWithinPartitions(F.desc("norm")).select("id", "v", "norm"), f"ordered-{dim}")
        head = own.orderBy(F.desc("norm"), "id").limit(HEAD).select("id", "v", "norm").toArrow()
        asked = scratch.keep(own.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v")), f"queries-{dim}")
        blocks, asks = max(1, -(-asked.count() // QUERIES)), False
        for i in range(blocks):
            part = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i).toArrow()
            if not part.num_rows:
                continue
            ids_q, queries = np.asarray(part.column("id").combine_chunks()), _rows([v for c in part.column("v").chunks for v in c], dim)
            best = _Best(len(ids_q), k)
            q, c = Turned.of(ids_q, queries, axes), Turned.of(np.asarray(head.column("id").combine_chunks()), _rows([v for c in head.column("v").chunks for v in c], dim), axes)
            for low in range(0, len(c.ids), 128):
                scan(best, q, c.part(slice(low, low + 128)))
            sent = spark.sparkContext.broadcast((ids_q, queries, best.kth))  # QUERIES vectors at most
            long_enough = ordered.where(F.col("norm") >= least_length(best, q))  # files by falling length: the short ones are not read
            scratch.keep(long_enough.mapInArrow(_searcher(dim, k, axes, sent), schema), f"found-{dim}/block={i}")
            sent.destroy()  # its results are written
            asks = True
        if asks:
            found.append(f"{scratch.root}/found-{dim}")
        scratch.drop(f"ordered-{dim}", f"queries-{dim}")
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    rows = reduce(DataFrame.union, [spark.read.schema(f"{schema}, block int").parquet(path) for path in found])
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
