"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors of cosine c are ``sqrt(2 - 2c)`` apart. They are rotated to their
principal directions, put on a grid of that width in the leading ones and sorted
by cell. The sorted sequence is cut into intervals; pairs of intervals are split
in halves as long as their bounding boxes may hold close vectors and dropped
when they are provably further apart. Pairs that are left are compared in double
precision. A task returns counts and a spanning forest of its links, never
the links.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from layoutcheck.llm.graph import components
from layoutcheck.llm.shared import Scratch, partitions, small_batches

COSINE = 0.9
#: Leading principal directions that make up the grid.
GRID_DIMS = 8
#: Bytes of the vectors in an interval that tasks compare, and vectors in the smallest interval of the recursion.
INTERVAL_BYTES, LEAF = 8 << 20, 128
#: Intervals that a range of the sequence holds on average, and ranges at most; beyond them, ranges hold more intervals.
RANGE, MOST_RANGES = 4, 4096
#: Intervals whose boxes make up one box of the level above.
FANOUT = 16
#: Slack for rounding in a rotated distance.
SLACK = 1e-9

_VECTOR = "id long, dim int, v binary"


def _cleaner(batches):
    """Vectors that can link, scaled to length one in double precision."""
    for batch in batches:
        ids, dims, out = [], [], []
        for i, v in zip(batch.column("id").to_pylist(), batch.column("v")):
            if not v.is_valid or v.values.null_count or not len(v.values):
                continue
            x = np.asarray(v.values).astype(np.float64)
            if not np.isfinite(x).all() or not x.any():
                continue
            x = x / np.abs(x).max()
            ids.append(i)
            dims.append(len(x))
            out.append((x / np.sqrt(x @ x)).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(out, pa.binary())], ["id", "dim", "v"])


def _rows(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in column), np.float64).reshape(-1, dim)


def _moments(dim: int):
    """Sums of products, which give the principal directions of all vectors."""

    def run(batches):
        total = np.zeros((dim, dim))
        for batch in batches:
            x = _rows(batch.column("v"), dim)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    return run


def _adder(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(b.as_buffer(), np.float64) for c in table.column("m").chunks for b in c)
    return pa.table({"m": pa.array([total.tobytes()], pa.binary())})


def _rotator(dim: int, axes: np.ndarray, width: float):
    def run(batches):
        for batch in batches:
            x = _rows(batch.column("v"), dim) @ axes
            cells = np.clip(np.floor(x[:, :GRID_DIMS] / width).astype(np.int64) + 32, 0, 63)  # an order only; boxes come from the coordinates
            key = np.zeros(len(x), np.int64)
            for d in range(cells.shape[1]):
                key = key * 64 + cells[:, d]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(key), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "key", "v"])

    return run


def _interval(dim: int):
    """One row of an interval: its vectors in grid order and their bounding box in the leading directions."""

    def run(table: pa.Table) -> pa.Table:
        order = np.lexsort((np.asarray(table.column("id")), np.asarray(table.column("key"))))
        x = np.frombuffer(b"".join(v.as_py() for c in table.column("v").chunks for v in c), np.float64).reshape(-1, dim)[order]
        lead = x[:, :GRID_DIMS]
        return pa.table(
            {
                "range": pa.array([table.column("range")[0].as_py()], pa.int32()),
                "part": pa.array([table.column("part")[0].as_py()], pa.int64()),
                "ids": pa.array([np.asarray(table.column("id"))[order].tobytes()], pa.binary()),
                "vs": pa.array([x.tobytes()], pa.binary()),
                "low": pa.array([lead.min(0)], pa.list_(pa.float64())),
                "high": pa.array([lead.max(0)], pa.list_(pa.float64())),
            }
        )

    return run


def _apart(low_a, high_a, low_b, high_b, width: float) -> bool:
    gap = np.maximum(0, np.maximum(low_a - high_b, low_b - high_a))
    return float(gap @ gap) > (width + SLACK) ** 2


def _join(a: np.ndarray, b: np.ndarray | None, cosine: float, width: float):
    """Index pairs of links between two sequences, or within one (b None), leaf block by leaf block."""
    other = a if b is None else b

    def boxes(x):
        cuts = np.arange(0, len(x), LEAF)
        lead = x[:, :GRID_DIMS]
        return np.minimum.reduceat(lead, cuts), np.maximum.reduceat(lead, cuts)

    (low_a, high_a), (low_b, high_b) = boxes(a), boxes(other)
    todo = [(0, len(low_a), 0, len(low_b))]
    while todo:  # halves of both sequences, until they are leaves
        i, j, k, m = todo.pop()
        if b is None and k < i:  # halves of one sequence are the same or disjoint
            continue
        if _apart(low_a[i:j].min(0), high_a[i:j].max(0), low_b[k:m].min(0), high_b[k:m].max(0), width):
            continue
        if j - i <= 1 and m - k <= 1:
            x, y = slice(i * LEAF, j * LEAF), slice(k * LEAF, m * LEAF)
            hit = a[x] @ other[y].T >= cosine
            if b is None and i == k:
                hit = np.triu(hit, 1)
            p, q = np.nonzero(hit)
            yield p + i * LEAF, q + k * LEAF
            continue
        left = [(i, j)] if j - i <= 1 else [(i, (i + j) // 2), ((i + j) // 2, j)]
        right = [(k, m)] if m - k <= 1 else [(k, (k + m) // 2), ((k + m) // 2, m)]
        todo += [(*p, *q) for p in left for q in right]


def _forest(n: int):
    parent = np.arange(n)

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def unite(p: np.ndarray, q: np.ndarray):
        top = parent.copy()
        while True:  # roots of all at once
            up = top[top]
            if (up == top).all():
                break
            top = up
        parent[:] = top
        cross = np.flatnonzero(top[p] != top[q])
        for x, y in {(int(top[p[i]]), int(top[q[i]])) for i in cross}:
            x, y = find(x), find(y)
            if x != y:
                parent[max(x, y)] = min(x, y)

    return parent, find, unite


def _comparer(dim: int, cosine: float, width: float):
    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda name: batch.column(name)[row].as_buffer()  # noqa: E731, B023
                ids = np.frombuffer(get("ids_a"), np.int64)
                a = np.frombuffer(get("vs_a"), np.float64).reshape(-1, dim)
                b, n = None, len(a)
                if not batch.column("same")[row].as_py():
                    b = np.frombuffer(get("vs_b"), np.float64).reshape(-1, dim)
                    ids = np.concatenate((ids, np.frombuffer(get("ids_b"), np.int64)))
                count, (parent, find, unite) = np.zeros(len(ids), np.int64), _forest(len(ids))
                for p, q in _join(a, b, cosine, width):
                    q = q if b is None else q + n
                    count += np.bincount(p, minlength=len(ids)) + np.bincount(q, minlength=len(ids))
                    unite(p, q)
                some = np.flatnonzero(count)
                root = np.array([find(int(i)) for i in some], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(count[some]), pa.array(ids[root])], ["id", "n", "root"])

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, n_links, component_id, kept of every row.

    Vectors that are null, empty or zero or hold null or non-finite components
    link with nothing; vectors of different lengths do not link. Rows are
    compared as rows: rows of one id add up to one node, and do link with each
    other (which counts). Rows with a null id link with nothing and have no
    component. Other columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    small_batches(spark, 2048)
    scratch = Scratch(spark, "near-vectors")
    width = float(np.sqrt(2 - 2 * cosine))
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").alias("v"))
    clean = scratch.keep(rows.where("id IS NOT NULL").mapInArrow(_cleaner, _VECTOR), "clean")
    counts: list[DataFrame] = []
    for dim, number in clean.groupBy("dim").count().collect():  # one or a few lengths
        own = clean.where(F.col("dim") == dim)
        (moments,) = own.mapInArrow(_moments(dim), "m binary").groupBy().applyInArrow(_adder, "m binary").first()
        _, axes = np.linalg.eigh(np.frombuffer(moments, np.float64).reshape(dim, dim))
        turned = scratch.keep(own.mapInArrow(_rotator(dim, axes[:, ::-1].copy(), width), "id long, key long, v binary"), f"turned-{dim}")
        ranked = _intervals(turned, number, max(1, INTERVAL_BYTES // (8 * dim)))
        seq = scratch.keep(ranked.groupBy("range", "part").applyInArrow(_interval(dim), "range int, part long, ids binary, vs binary, low array<double>, high array<double>"), f"intervals-{dim}")
        seq, n = _numbered(seq)
        table, number_of_pairs = _close_pairs(seq.select("interval", "low", "high"), n, width, scratch, f"pairs-{dim}")
        a = seq.select(F.col("interval").alias("i"), F.col("ids").alias("ids_a"), F.col("vs").alias("vs_a"))
        b = seq.select(F.col("interval").alias("j"), F.col("ids").alias("ids_b"), F.col("vs").alias("vs_b"))
        # each task gets few pairs, whose vectors it reads one pair at a time
        small_batches(spark, 1)
        met = table.repartition(int(max(partitions(spark), min(number_of_pairs, 20_000))), "i", "j").join(a, "i").join(b, "j").withColumn("same", F.expr("i = j"))
        counts.append(scratch.keep(met.mapInArrow(_comparer(dim, cosine, width), "id long, n long, root long"), f"found-{dim}"))
        scratch.drop(f"turned-{dim}", f"intervals-{dim}", f"pairs-{dim}")
    small_batches(spark)
    everything = rows.select("id")
    if not counts:
        return everything.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    found = counts[0]
    for more in counts[1:]:
        found = found.union(more)
    links = found.groupBy("id").agg(F.sum("n").alias("n_links"))
    labels = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")), scratch)
    done = everything.join(links, "id", "left").join(labels.withColumnRenamed("node", "id"), "id", "left")
    component = F.coalesce("component", "id")
    return done.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"))


def _close_pairs(boxes: DataFrame, n: int, width: float, scratch: Scratch, name: str) -> tuple[DataFrame, int]:
    """(i, j), i <= j, of intervals that are not provably apart, and their number.

    Boxes of FANOUT neighbours make one box of the next level, up to at most
    FANOUT boxes, all of whose pairs are tried; from there down, only parts of
    close pairs meet. Boxes and pairs stay tables.
    """
    spark, levels = scratch.spark, [boxes.select(F.col("interval").cast("long").alias("at"), "low", "high")]
    size = n
    while size > FANOUT:
        bounds = [f(F.get(side, F.lit(d))).alias(f"{side}{d}") for side, f in (("low", F.min), ("high", F.max)) for d in range(GRID_DIMS)]
        grouped = levels[-1].groupBy(F.floor(F.col("at") / FANOUT).alias("at")).agg(*bounds)
        sides = (F.filter(F.array(*(F.col(f"{side}{d}") for d in range(GRID_DIMS))), lambda x: x.isNotNull()).alias(side) for side in ("low", "high"))
        levels.append(scratch.keep(grouped.select("at", *sides), f"{name}/boxes-{len(levels)}"))
        size = -(-size // FANOUT)
    gap = F.zip_with("gaps_low", "gaps_high", lambda x, y: F.greatest(x, y, F.lit(0.0)))
    far = F.aggregate(gap, F.lit(0.0), lambda total, x: total + x * x) > (width + SLACK) ** 2
    pairs = spark.createDataFrame([(0, 0)], "i long, j long")
    for depth, level in enumerate(reversed(levels)):
        part = lambda c: F.explode(F.sequence(F.col(c) * FANOUT, F.col(c) * FANOUT + (FANOUT - 1)))
        pairs = pairs.withColumn("i", part("i")).withColumn("j", part("j")).where("i <= j")
        a, b = level.toDF("i", "low_a", "high_a"), level.toDF("j", "low_b", "high_b")
        met = pairs.join(a, "i").join(b, "j")
        met = met.withColumn("gaps_low", F.zip_with("low_a", "high_b", lambda x, y: x - y)).withColumn("gaps_high", F.zip_with("low_b", "high_a", lambda x, y: x - y))
        pairs = scratch.keep(met.where(~far).select("i", "j"), f"{name}/level-{depth}")
    return pairs.select(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j")), pairs.count()


def _numbered(seq: DataFrame) -> tuple[DataFrame, int]:
    """Intervals numbered along the sequence, and their number."""
    counts, offsets, n = seq.groupBy("range").count().orderBy("range").collect(), [], 0  # MOST_RANGES at most
    for held, number in counts:
        offsets.append((held, n))
        n += number
    starts = F.broadcast(seq.sparkSession.createDataFrame(offsets, "range int, start long"))
    return seq.join(starts, "range").withColumn("interval", F.col("start") + F.col("part")).drop("range", "part", "start"), n


def _intervals(turned: DataFrame, number: int, rows: int) -> DataFrame:
    """Rows with their range of the sequence by key and their part of it, of at most ``rows`` rows.

    Ranges are cut by a sample, parts exactly; equal keys may be cut, for boxes are taken afterwards.
    """
    # Keys are spread by a hash of the id in their last bits, so that a full cell is cut evenly too.
    spread = F.pmod(F.xxhash64("id"), F.lit(1 << 20))
    n = int(min(max(1, number // (rows * RANGE)), MOST_RANGES))
    edges = []
    if n > 1:
        cuts = turned.select(F.struct("key", spread.alias("spread")).alias("k")).sample(fraction=min(1.0, 100 * n / number), seed=3).groupBy().agg(F.sort_array(F.collect_list("k")).alias("ks")).first()[0]
        edges = [cuts[len(cuts) * i // n] for i in range(1, n)] if cuts else []
    keys, spreads = np.array([e[0] for e in edges], np.int64), np.array([e[1] for e in edges], np.int64)

    def place(batches):
        for batch in batches:
            key, own = np.asarray(batch.column("key")), np.asarray(batch.column("spread"))
            low, high = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
            at = np.array([lo + np.searchsorted(spreads[lo:hi], s, "right") if hi > lo else lo for lo, hi, s in zip(low, high, own)], np.int32)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "key", "spread", "v")), pa.array(at)], ["id", "key", "spread", "v", "range"])

    placed = turned.withColumn("spread", spread).mapInArrow(place, "id long, key long, spread long, v binary, range int")
    nth = F.row_number().over(Window.partitionBy("range").orderBy("key", "spread", "id")) - 1
    held = F.count("*").over(Window.partitionBy("range"))
    # the grouping by range and part finds rows of a range together already
    return placed.select("*", nth.alias("nth"), held.alias("held")).select("id", "key", "v", "range", F.floor(F.col("nth") * F.ceil(F.col("held") / rows) / F.col("held")).cast("long").alias("part"))
