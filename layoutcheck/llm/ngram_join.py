"""Self-join of documents by the Jaccard similarity of their word n-gram sets, with adaptive multi-match prefixes.

Sets are ordered by estimated frequency, rare n-grams first. If two sets of a
and b elements overlap in at least t of them, the first ``a - t + l`` and
``b - t + l`` elements share at least l, for any l. Each document picks its own
l by the estimated number of candidates: a longer prefix costs postings, yet a
candidate must then share that many more of them. A pair uses the smaller l.

Copies of one set are one class. A first round links each class to one leader
of each of its prefix elements; what that joins into one component needs no
further pairs, so a large group of near copies costs a star, not all its pairs.
A second round tests every remaining pair of classes that share enough of their
prefixes and are in different components. The components are exact.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layoutcheck.llm import words
from layoutcheck.llm.graph import components
from layoutcheck.llm.shared import Scratch, batches_of, partitions, small_batches, task
from layoutcheck.llm.substring import _read, _write

N = 3
#: Similarity in hundredths.
THRESHOLD = 90
#: The frequency sketch: rows of cells, as many as the n-grams call for, from 4 to 32 MB; each slice of cells has its owner.
SKETCH_ROWS, LEAST_BITS, MOST_BITS, SLICE_BITS = 2, 19, 22, 16
#: Longest match that a document may ask for, and what verifying a candidate costs, in postings.
MOST_MATCHES, VERIFY = 4, 16.0
#: log2 of the bits of the map of documents whose sets are needed: eight for each document, from 128 KB to 64 MB.
LEAST_NEEDED, MOST_NEEDED = 20, 29
#: Postings that a block gathers before it sends, and bytes of postings that a task sorts at once.
BLOCK = 250_000
BUCKET_BYTES = 4 << 20

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xE7037ED1A0B428DB], np.uint64)
_POSTING = (np.uint64, np.int64, np.uint32, np.uint32, np.uint8)  # token, class, set size, place in the order, l


def required(n, threshold: int = THRESHOLD):
    """Least overlap of a set of n elements with any set it links with."""
    return (threshold * n + 99) // 100


def _log2(n: float, least: int, most: int) -> int:
    return int(min(max(np.ceil(np.log2(max(n, 1))), least), most))


def _cells(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    return ((h * _MULTIPLIERS[row]) >> np.uint64(64 - bits)).astype(np.int64)


def _sets(batches, n: int):
    """(run of rows, n-gram set of each row as ascending hashes)."""
    for whole in batches:
        for batch in words.chunks(whole, "text"):
            h, first = words.hashes(*words.column(batch.column("text")), lower=True)
            runs, row, _ = words.windows(h, first, n)
            cuts = np.searchsorted(row, np.arange(batch.num_rows + 1))
            sets = []
            for i in range(batch.num_rows):
                k = first[i + 1] - first[i]
                if 0 < k < n:  # the whole sequence is one element, told apart by its length
                    own = h[first[i] : first[i + 1]]
                    sets.append(words.mix(words.run_hashes(own, int(k)) + np.uint64(k)))
                else:
                    sets.append(np.unique(runs[cuts[i] : cuts[i + 1]]))
            yield batch, sets


def _class_of(own: np.ndarray) -> int:
    """A 64-bit hash of a set; with the set's size it names the class of its copies."""
    return int(words.mix(np.array([words.mix(own ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64)]))[0].astype(np.int64))


def _counter(n: int, bits: int):
    def run(batches):
        count = np.zeros((SKETCH_ROWS, 1 << bits), np.uint32)
        held, size = [], 0

        def add():
            h = np.concatenate(held)
            for row in range(SKETCH_ROWS):
                count[row] += np.bincount(_cells(h, row, bits), minlength=1 << bits).astype(np.uint32)

        def rows(kind, ids, marks, sizes, classes, slices, blobs):
            return pa.RecordBatch.from_arrays([pa.array([kind] * len(ids), pa.int32()), pa.array(ids, pa.int64()), pa.array(marks, pa.int64()), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), pa.array(slices, pa.int32()), pa.array(blobs, pa.binary())], ["kind", "doc_id", "mark", "n", "class", "slice", "blob"])

        for batch, sets in _sets(batches, n):
            k = len(sets)
            yield rows(0, batch.column("doc_id").to_pylist(), batch.column("mark").to_pylist(), [len(s) for s in sets], [_class_of(s) if len(s) else 0 for s in sets], [None] * k, [None] * k)
            held += sets
            size += sum(map(len, sets))
            if size > BLOCK:
                add()
                held, size = [], 0
        if held:
            add()
        parts = count.reshape(-1, 1 << SLICE_BITS)
        if count.any():
            yield rows(1, [None] * len(parts), [None] * len(parts), [None] * len(parts), [None] * len(parts), list(range(len(parts))), [_write(p) for p in parts])

    return run


def _adder(batches):
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
            (own,) = _read([blob.as_buffer()], (np.uint32,))
            total[i] = total.get(i, 0.0) + own.astype(np.float32)
    for i, own in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([own.tobytes()], pa.binary())], ["slice", "blob"])


def matches(estimates: np.ndarray, base: int, documents: int) -> int:
    """How many prefix elements to ask for: the least estimated cost.

    estimates: ascending frequencies of the first base + MOST_MATCHES - 1
    elements, each with one more than the sketch shows, which may hide in its
    noise. The documents outside a group of near copies that share l or more of
    them are taken as Poisson-distributed.
    """
    best, least = 1, np.inf
    for m in range(1, len(estimates) - base + 2):
        postings = float(estimates[: base + m - 1].sum())
        mean, tail, term = postings / max(documents, 1), 0.0, 1.0
        for i in range(m):
            tail += term
            term *= mean / (i + 1)
        cost = postings + VERIFY * max(documents * (1.0 - np.exp(-mean) * tail), 0.0) if mean < 30 else np.inf
        if cost < least * 0.999:
            best, least = m, cost
    return best


def _poster(n: int, threshold: int, sketch, documents: int, buckets: int):
    def run(batches):
        count = np.frombuffer(sketch.value, np.float32).reshape(SKETCH_ROWS, -1)
        bits = count.shape[1].bit_length() - 1
        noise = count.mean(axis=1)
        held, size, seen = [], 0, set()

        def send():
            token, cls, sizes, at, ask = (np.concatenate(x) for x in zip(*held))
            own = ((token >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(own, kind="stable")
            own, token, cls, sizes, at, ask = (x[order] for x in (own, token, cls, sizes, at, ask))
            cuts = np.flatnonzero(np.diff(own, prepend=-1, append=-1))
            pairs = list(zip(cuts[:-1], cuts[1:]))
            return pa.RecordBatch.from_arrays([pa.array([int(own[i]) for i, _ in pairs], pa.int32()), pa.array([_write(*(x[i:j] for x in (token, cls, sizes, at, ask))) for i, j in pairs], pa.binary())], ["bucket", "blob"])

        for _, sets in _sets(batches, n):
            for own in sets:
                k = len(own)
                cls = _class_of(own) if k else 0
                if not k or (cls, k) in seen:  # copies in one block post once
                    continue
                seen.add((cls, k))
                least = required(k, threshold)
                rare = np.minimum(*(np.maximum(count[row][_cells(own, row, bits)] - noise[row], 0) for row in range(SKETCH_ROWS))) + 1
                most = min(MOST_MATCHES, least)
                reach = k - least + most
                order = np.lexsort((own, rare))[:reach]
                ask = matches(rare[order], k - least + 1, documents)
                reach = k - least + ask
                held.append((own[order[:reach]], np.full(reach, cls, np.int64), np.full(reach, k, np.uint32), np.arange(reach, dtype=np.uint32), np.full(reach, ask, np.uint8)))
                size += reach
            if size >= BLOCK:
                yield send()
                held, size, seen = [], 0, set()
        if size:
            yield send()

    return run


def _lister(table: pa.Table) -> pa.Table:
    """Postings of elements that two classes have, each class once."""
    token, cls, sizes, at, ask = _read([b.as_buffer() for c in table.column("blob").chunks for b in c], _POSTING)
    order = np.lexsort((sizes, cls, token))
    token, cls, sizes, at, ask = (x[order] for x in (token, cls, sizes, at, ask))
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (cls[1:] != cls[:-1]) | (sizes[1:] != sizes[:-1])
    token, cls, sizes, at, ask = (x[new] for x in (token, cls, sizes, at, ask))
    same = token[1:] == token[:-1]
    shared = np.zeros(len(token), bool)
    shared[1:] |= same
    shared[:-1] |= same
    return pa.table({"token": token[shared].view(np.int64), "class": cls[shared], "n": sizes[shared].astype(np.int64), "at": at[shared].astype(np.int32), "ask": ask[shared].astype(np.int32)})


def _fetcher(n: int, needed):
    def run(batches):
        bits = np.frombuffer(needed.value, np.uint8)

        def wanted():
            for batch in batches:
                at = np.asarray(batch.column("place")).astype(np.int64)
                keep = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
                if keep.any():
                    yield batch.filter(pa.array(keep))

        for batch, sets in _sets(wanted(), n):
            once = {(_class_of(s), len(s)): s for s in sets if len(s)}
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in once], pa.int64()), pa.array([s.tobytes() for s in once.values()], pa.binary())], ["class", "elements"])

    return run


def _verifier(threshold: int):
    def run(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("set_a"), batch.column("set_b")):
                a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                both = np.concatenate((a, b))
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= threshold * (len(both) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


class _Verify:
    """Exact tests of candidate pairs; reads only the texts that pairs need, once."""

    def __init__(self, docs: DataFrame, ids: DataFrame, scratch: Scratch, n: int, threshold: int, bits: int):
        self.docs, self.ids, self.scratch, self.n, self.threshold, self.bits, self.sets, self.round = docs, ids, scratch, n, threshold, bits, None, 0

    def __call__(self, pairs: DataFrame) -> DataFrame:
        spark, self.round = self.docs.sparkSession, self.round + 1
        pairs = self.scratch.keep(pairs, f"pairs-{self.round}")
        need = pairs.select(F.col("a").alias("class")).union(pairs.select(F.col("b").alias("class"))).distinct()
        if self.sets is not None:
            need = need.join(self.sets.select("class"), "class", "left_anti")
        place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << self.bits)).cast("int")
        places = self.ids.join(need, "class").select(place.alias("place")).selectExpr("place div 64 AS word", "shiftleft(1L, place % 64) AS bit")
        bits = np.zeros(1 << self.bits - 6, np.uint64)
        got = places.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # at most a word for each 64 bits
        bits[np.asarray(got.column("word"))] = np.asarray(got.column("bits")).view(np.uint64)
        needed = spark.sparkContext.broadcast(bits.tobytes())
        found = self.docs.withColumn("place", place).mapInArrow(task(_fetcher(self.n, needed)), "class long, elements binary")
        found = found.join(need, "class", "left_semi").groupBy("class").agg(F.first("elements").alias("elements"))
        found = self.scratch.keep(found, f"sets-{self.round}")
        self.sets = found if self.sets is None else self.sets.union(found)
        a = self.sets.select(F.col("class").alias("a"), F.col("elements").alias("set_a"))
        b = self.sets.select(F.col("class").alias("b"), F.col("elements").alias("set_b"))
        with batches_of(spark, 16):  # two whole sets a row
            return self.scratch.keep(pairs.join(a, "a").join(b, "b").mapInArrow(_verifier(self.threshold), "a long, b long"), f"links-{self.round}")


def jaccard_components(docs: DataFrame, n: int = N, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, mark, component of every row.

    Words are lower-cased in A-Z. A text with fewer than n words is one element,
    a null or empty text an empty set that links with nothing, so such a row is
    its own component. Rows with a null id take part in links but name no
    component unless all of it is null. Rows of one id with different texts
    count as documents of their own; repeated rows stay. Texts of any length are
    read whole, in pieces cut between words. Other columns are ignored. An empty table gives no rows. ``mark`` is xxhash64 of id and text,
    ``component`` names a component, null for empty sets. threshold: hundredths,
    above 50.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "ngram-join")
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = _log2(size / 96, LEAST_BITS, MOST_BITS)  # about a cell for 16 words, until the sketch is full
    first = scratch.keep(docs.withColumn("mark", F.xxhash64("doc_id", "text")).mapInArrow(task(_counter(n, bits)), "kind int, doc_id long, mark long, n long, class long, slice int, blob binary"), "first")
    ids = first.where("kind = 0").select("doc_id", "mark", "n", "class")
    sketch = bytearray(SKETCH_ROWS << bits + 2)  # 32 MB at most
    cells = np.frombuffer(sketch, np.float32).reshape(-1, 1 << SLICE_BITS)
    for i, blob in first.where("kind = 1").select("slice", "blob").repartition(partitions(spark), "slice").mapInArrow(_adder, "slice int, blob binary").toLocalIterator():
        cells[i] = np.frombuffer(blob, np.float32)
    documents, elements = ids.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    buckets = int(max(partitions(spark), elements * 25 * (100 - threshold) // 100 // BUCKET_BYTES))
    shared = spark.sparkContext.broadcast(sketch)
    posted = docs.mapInArrow(task(_poster(n, threshold, shared, documents, buckets)), "bucket int, blob binary")
    lists = scratch.keep(posted.groupBy("bucket").applyInArrow(_lister, "token long, class long, n long, at int, ask int"), "lists")
    shared.destroy()
    del shared, sketch, cells, posted
    ids_of_some = ids.groupBy("class").agg(F.min("doc_id").alias("doc_id"))
    verify = _Verify(docs, ids_of_some, scratch, n, threshold, _log2(8 * documents, LEAST_NEEDED, MOST_NEEDED))

    level = F.greatest(F.lit(1), F.col("at") - (F.col("n") - F.floor((threshold * F.col("n") + 99) / 100)) + 1).cast("int")
    lists = lists.withColumn("level", level)
    prefixes = scratch.keep(lists.groupBy("class").agg(F.first("ask").alias("ask"), F.collect_list(F.struct("token", "level")).alias("prefix")), "prefixes")

    def band(size: F.Column) -> F.Column:
        """Sizes that grow by a band, so that a set meets its own band and the next."""
        return F.floor(F.log(size.cast("double")) / float(np.log(100 / threshold))).cast("int")

    def met(x: DataFrame, y: DataFrame, apart: F.Column) -> DataFrame:
        """Pairs that share an element of both shortest prefixes, at places and with sizes that allow a link; x's set is not the larger one.

        The first element that a linking pair shares passes this.
        """
        na, nb = F.col("x.n"), F.col("y.n")
        overlap = F.floor((threshold * (na + nb) + 99 + threshold) / (100 + threshold))
        fits = (na <= nb) & (100 * na >= threshold * nb) & (F.least(na - F.col("x.at"), nb - F.col("y.at")) >= overlap)
        x = x.where("level = 1").withColumn("band", F.explode(F.sequence(band(F.col("n")), band(F.floor(100 * F.col("n") / threshold)))))
        y = y.where("level = 1").withColumn("band", band(F.col("n")))
        both = x.alias("x").join(y.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.col("x.band") == F.col("y.band"))).where(apart & fits)
        return both.select(F.least("x.class", "y.class").alias("a"), F.greatest("x.class", "y.class").alias("b")).distinct()

    def matched(pairs: DataFrame) -> DataFrame:
        """Pairs that share as many elements of their longer prefixes as the smaller l asks for."""
        own = lambda side: prefixes.select(*(F.col(c).alias(f"{c}_{side}") for c in ("class", "ask", "prefix")))
        ask = F.least("ask_a", "ask_b")
        within = lambda side: F.transform(F.filter(f"prefix_{side}", lambda e: e["level"] <= ask), lambda e: e["token"])
        wide = pairs.join(own("a"), F.col("a") == F.col("class_a")).join(own("b"), F.col("b") == F.col("class_b"))
        return wide.where(F.size(F.array_intersect(within("a"), within("b"))) >= ask).select("a", "b")

    leaders = lists.where("level = 1").groupBy("token").agg(F.min(F.struct("at", "class", "n", "level")).alias("l")).select("token", "l.*")
    other = F.col("x.class") != F.col("y.class")
    links = verify(matched(met(lists, leaders, other).union(met(leaders, lists, other)).distinct()))

    joined = components(links, scratch, "stars")
    lists = lists.join(joined.select(F.col("node").alias("class"), "component"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    lists = scratch.keep(lists, "lists-2")
    open_tokens = lists.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("token")
    lists = lists.join(open_tokens, "token", "left_semi")
    rest = met(lists, lists, F.col("x.component") != F.col("y.component"))
    tested = spark.read.parquet(f"{scratch.root}/pairs-1")
    more = verify(matched(rest.join(tested, ["a", "b"], "left_anti")))

    labels = components(links.union(more), scratch, "all").select(F.col("node").alias("class"), "component")
    scratch.drop("lists", "lists-2", "prefixes", *(f"{kind}-{i}" for kind in ("pairs", "sets", "links") for i in (1, 2)))
    classes = ids.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("least")).join(labels, "class", "left").withColumn("component", F.coalesce("component", "class"))
    roots = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    named = classes.join(roots, "component").select("class", "component", "component_id")
    done = ids.withColumn("class", F.when(F.col("n") > 0, F.col("class"))).join(named, "class", "left")
    done = scratch.keep(done.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "mark", "component"), "result")
    scratch.drop("first", *(f"{name}-{i}" for name in ("stars", "all") for i in range(60)))
    return done
