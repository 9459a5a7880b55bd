import zlib
from collections import Counter

import numpy as np
import pytest

from layoutcheck.llm.sharding import assign_shards, jump, write_shards


def plain_jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("shards", [1, 2, 8, 9, 1000])
def test_jump(shards):
    keys = np.random.default_rng(1).integers(0, 2**63, 500).astype(np.uint64) * np.uint64(2)
    assert jump(keys, shards).tolist() == [plain_jump(int(k), shards) for k in keys]
    assert jump(keys[:0], shards).tolist() == []


def test_few_keys_move_and_only_into_the_new_shard():
    keys = np.arange(20_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    before, after = jump(keys, 8), jump(keys, 9)
    moved = before != after
    assert (after[moved] == 8).all() and abs(moved.mean() - 1 / 9) < 0.01
    assert max(Counter(before.tolist()).values()) < 1.1 * len(keys) / 8


def test_assignment(documents):
    rows = [(i, f"text {i % 37} é" if i % 11 else None) for i in range(500)]
    got = assign_shards(documents(rows)).collect()
    text = dict(rows)
    assert len(got) == 500 and {r["law"] for r in got} == {"key"}
    for r in got:
        raw = (text[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
        assert r["grown_shard"] in (r["shard"], 8)
    for s in range(8):
        own = sorted(r["slot"] for r in got if r["shard"] == s)
        assert own == list(range(len(own))) and own
    assert sorted(map(repr, got)) == sorted(map(repr, assign_shards(documents(rows[::-1])).collect()))


def test_odd_rows(spark, documents, tmp_path):
    rows = [(None, "a"), (None, None), (0, ""), (5, "x"), (5, "x"), (5, "y"), (-7, "z")]
    got = assign_shards(documents(rows).selectExpr("*", "1 AS shard", "2 AS size", "3 AS `range`")).collect()
    assert len(got) == 7 and len({r["shard"] for r in got if r["doc_id"] in (None, 0)}) == 1 and len({r["shard"] for r in got if r["doc_id"] == 5}) == 1
    assert Counter((r["shard"], r["slot"]) for r in got).most_common(1)[0][1] == 1
    assert assign_shards(documents([(1, "a")]).where("false")).count() == 0
    write_shards(documents([(i, str(i)) for i in range(50)]), str(tmp_path / "out"))
    back = {r["doc_id"]: r["shard"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert back == {r["doc_id"]: r["shard"] for r in assign_shards(documents([(i, str(i)) for i in range(50)])).collect()}
