"""Removal of word windows that an earlier document already has: count-min prefilter, then exact groups.

1. Every block of documents sends the cells of its windows' hashes; the owners
   of the sketch's slices merge them into "estimated twice or more" bits. The
   estimate never falls short, so no repeated window is lost.
2. Only windows that are estimated repeated are grouped, by a 96-bit key. A
   block settles its own repeats first and sends a key once for its smallest
   document, so a passage that many documents share costs a row a block.
3. The positions to remove meet the texts by one join.

The sketch grows with the text up to ``sketch_bytes``. Beyond that it lets more
windows pass, which costs shuffle and changes no result.
"""

import zlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from layoutcheck.llm import sketch, words
from layoutcheck.llm.shared import partitions, small_batches, task

WINDOW = 13
#: Most bytes of the merged sketch, which every Python worker holds once.
SKETCH_BYTES = 128 << 20
#: Windows that a block gathers before it sends.
BLOCK = 2_000_000
#: Bytes of text for each group of keys.
BUCKET_BYTES = 4 << 20

_DOC, _TAG, _TEXT, _AT = "__doc", "__tag", "__text", "__at"


def _planes(values: np.ndarray) -> bytes:
    """Bytes by significance, which compress better than values one by one."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes()


def _values(blob: memoryview, n: int, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8, n * size).reshape(size, n).T).view(kind).reshape(n)


def _write(*columns: np.ndarray) -> bytes:
    return b"".join(map(_planes, columns))


def _read(blobs, kinds) -> list[np.ndarray]:
    sizes = [np.dtype(k).itemsize for k in kinds]
    found = [[] for _ in kinds]
    for blob in blobs:
        n, at = len(blob) // sum(sizes), 0
        for own, kind, size in zip(found, kinds, sizes):
            own.append(_values(memoryview(blob)[at : at + n * size], n, kind))
            at += n * size
    return [np.concatenate(x) if x else np.zeros(0, k) for x, k in zip(found, kinds)]


_KEYED = (np.uint64, np.uint32, np.int64, np.uint32, np.uint32)  # key, rest of the key, document, tag, position
_PLACED = (np.int64, np.uint32, np.uint32)  # document, tag, position
_SENT = "bucket int, kind int, target int, blob binary"


def _windows(batches, k: int):
    """Of runs of rows: bytes and offsets of the texts, first words; hash, row, position of all windows; documents; tags."""
    for batch in batches:
        for part in words.chunks(batch, _TEXT):
            texts = words.column(part.column(_TEXT))
            h, first = words.hashes(*texts)
            known = np.asarray(part.column(_DOC).is_valid())
            doc = np.asarray(part.column(_DOC).fill_null(0)).astype(np.int64)
            tag = np.asarray(part.column(_TAG).fill_null(0)).astype(np.uint32)
            key, row, at = words.windows(h, first, k)
            keep = known[row] if not known.all() else slice(None)
            yield texts, first, key[keep], row[keep], at[keep], doc, tag


def _sketcher(k: int, bits: int):
    def run(batches):
        held, size = [], 0

        def send():
            rows = list(sketch.block(np.concatenate(held), bits))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["slice", "once", "twice"])

        for _, _, key, row, _, _, _ in _windows(batches, k):
            order = np.lexsort((row, key))
            key, row = key[order], row[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])  # a document counts once
            held.append(key[new])
            size += len(held[-1])
            if size >= BLOCK:
                yield send()
                held, size = [], 0
        if size:
            yield send()

    return run


def _merger(batches):
    counts: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, once, twice in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            sketch.add(counts.setdefault(i, np.zeros(1 << sketch.SLICE, np.uint8)), once.as_buffer(), twice.as_buffer())
    for i, count in counts.items():
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([sketch.bits(count)], pa.binary())], ["slice", "bits"])


def _by_document(doc, tag, at, buckets: int):
    """(bucket of the document, blob) of places to remove."""
    own = (words.mix(doc.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((at, tag, doc, own))
    own, doc, tag, at = own[order], doc[order], tag[order], at[order]
    cuts = np.flatnonzero(np.diff(own, prepend=-1, append=-1)) if len(own) else np.zeros(1, int)
    for low, high in zip(cuts[:-1], cuts[1:]):
        yield int(own[low]), _write(doc[low:high], tag[low:high], at[low:high])


def _later(key, rest, doc):
    """Order by key and document; where in it a key begins; which rows have a larger document than their key's first."""
    order = np.lexsort((doc, rest, key))
    key, rest, doc = key[order], rest[order], doc[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (rest[1:] != rest[:-1])
    least = doc[np.flatnonzero(new)][np.cumsum(new) - 1] if len(key) else doc
    return order, doc > least


def _rows(rows):
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.binary()))], ["bucket", "kind", "target", "blob"])


def _sender(k: int, bits: int, merged, buckets: int):
    def run(batches):
        held, size = [], 0
        filled = np.frombuffer(merged.value, np.uint8).reshape(sketch.ROWS, -1)

        def send():
            key, rest, doc, tag, at = (np.concatenate(x) for x in zip(*held))
            order, later = _later(key, rest, doc)
            key, rest, doc, tag, at = (x[order] for x in (key, rest, doc, tag, at))
            rows = [(b, 1, b, blob) for b, blob in _by_document(doc[later], tag[later], at[later], buckets)]
            key, rest, doc, tag, at = (x[~later] for x in (key, rest, doc, tag, at))
            own = ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            cuts = np.flatnonzero(np.diff(own, prepend=-1, append=-1))
            rows += [(int(own[i]), 0, 0, _write(*(x[i:j] for x in (key, rest, doc, tag, at)))) for i, j in zip(cuts[:-1], cuts[1:])]
            return _rows(rows)

        for texts, first, key, row, at, doc, tag in _windows(batches, k):
            hit = np.flatnonzero(sketch.passes(key, bits, filled))
            if not len(hit):
                continue
            start = first[row[hit]] + at[hit]
            second = words.run_hashes(words.hashes(*texts, salt=1)[0], k, salt=1)  # of words hashed another way
            rest = (second[start] >> np.uint64(32)).astype(np.uint32)
            held.append((key[hit], rest, doc[row[hit]], tag[row[hit]], at[hit].astype(np.uint32)))
            size += len(hit)
            if size >= BLOCK // 2:
                yield send()
                held, size = [], 0
        if size:
            yield send()

    return run


def _grouper(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        kind = np.asarray(table.column("kind"))
        blobs = [b.as_buffer() for c in table.column("blob").chunks for b in c]
        rows = [(int(t), 0, 0, blobs[i].to_pybytes()) for i, t in enumerate(np.asarray(table.column("target"))) if kind[i] == 1]
        key, rest, doc, tag, at = _read([blobs[i] for i in np.flatnonzero(kind == 0)], _KEYED)
        order, later = _later(key, rest, doc)
        gone = order[later]
        rows += [(b, 0, 0, blob) for b, blob in _by_document(doc[gone], tag[gone], at[gone], buckets)]
        return pa.Table.from_batches([_rows(rows)])

    return run


def _places(table: pa.Table) -> pa.Table:
    doc, tag, at = _read([b.as_buffer() for c in table.column("blob").chunks for b in c], _PLACED)
    order = np.lexsort((at, tag, doc))
    doc, tag, at = doc[order], tag[order], at[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])
    cuts = np.append(np.flatnonzero(new), len(doc))
    return pa.table({_DOC: pa.array(doc[cuts[:-1]], pa.int64()), _TAG: pa.array(tag[cuts[:-1]].astype(np.int64), pa.int64()), _AT: pa.array([at[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:])], pa.binary())})


def _packer(text: str, columns: list[str]):
    """Texts travel to their removals compressed."""

    def run(batches):
        for batch in batches:
            packed = [None if t is None else zlib.compress(t, 1) for t in batch.column(text).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(packed, pa.binary())], [*columns, _TEXT])

    return run


def _cutter(k: int, text: str, kept: list[str]):
    def run(batches):
        for whole in batches:
            for low in range(0, whole.num_rows, 64):
                batch = whole.slice(low, 64)
                texts = [None if t is None else zlib.decompress(t) for t in batch.column(_TEXT).to_pylist()]
                out, total, removed = [], [], []
                for t, at in zip(texts, batch.column(_AT)):
                    own = (t or b"").split()
                    n = len(own)
                    if at.is_valid:
                        starts = np.frombuffer(at.as_buffer(), np.uint32).astype(np.int64)
                        cover = np.zeros(n + 1, np.int64)
                        np.add.at(cover, starts, 1)
                        np.add.at(cover, starts + k, -1)
                        own = list(compress(own, (np.cumsum(cover[:-1]) <= 0).tolist()))
                    out.append(b" ".join(own))
                    total.append(n)
                    removed.append(n - len(own))
                same = pa.array(texts, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*(same if c == text else batch.column(c) for c in kept), pa.array(out, pa.binary()).cast(pa.string()), pa.array(total, pa.int64()), pa.array(removed, pa.int64())], [*kept, "kept_text", "n_words", "n_removed"])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WINDOW, sketch_bytes: int = SKETCH_BYTES) -> DataFrame:
    """docs with ``kept_text`` (kept words joined by one space), ``n_words`` and ``n_removed``.

    A word goes if a window of k words that covers it also starts in a document
    with a smaller id. Defined results: a null text has no words; a document
    with a null id keeps all its words and removes none of others; rows of one
    id do not count as earlier than each other; repeated rows get the same
    result each; texts of under k words stay whole; an empty table gives an
    empty one; other columns pass, but for those named as the three results,
    which are replaced. Ids are integers.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kept = [c for c in docs.columns if c not in ("kept_text", "n_words", "n_removed")]
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias(_DOC), F.crc32(text.cast("binary")).alias(_TAG), text.alias(_TEXT))
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    bits = sketch.width_bits(size / 6, sketch_bytes)
    buckets = int(max(partitions(spark), size // BUCKET_BYTES))
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField("kept_text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])

    sent = rows.mapInArrow(task(_sketcher(k, bits)), "slice int, once binary, twice binary")
    slices = sent.repartition(partitions(spark), "slice").mapInArrow(_merger, "slice int, bits binary")
    merged = bytearray(sketch.ROWS << bits - 3)  # at most sketch_bytes
    filled = np.frombuffer(merged, np.uint8).reshape(-1, 1 << sketch.SLICE - 3)
    for i, b in slices.toLocalIterator(prefetchPartitions=False):
        filled[i] = np.frombuffer(b, np.uint8)
    shared = spark.sparkContext.broadcast(merged)
    del merged, filled

    keyed = rows.mapInArrow(task(_sender(k, bits, shared, buckets)), _SENT)
    found = keyed.groupBy("bucket").applyInArrow(_grouper(buckets), _SENT)
    places = found.groupBy("bucket").applyInArrow(_places, f"{_DOC} long, {_TAG} long, {_AT} binary")
    whole = docs.select(*(F.col(f"`{c}`") for c in dict.fromkeys([*kept, text_col])), F.col(f"`{id_col}`").cast("long").alias(_DOC), F.crc32(text.cast("binary")).alias(_TAG))
    others = [c for c in whole.columns if c != text_col]
    packed = whole.mapInArrow(_packer(text_col, others), T.StructType([*(whole.schema[c] for c in others), T.StructField(_TEXT, T.BinaryType())]))
    return packed.join(places, [_DOC, _TAG], "left").drop(_DOC, _TAG).mapInArrow(_cutter(k, text_col, kept), schema)
