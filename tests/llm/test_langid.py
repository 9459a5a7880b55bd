import zlib

import numpy as np
import pytest

from layoutcheck.llm import langid


def test_gradients_are_the_derivatives():
    r = np.random.default_rng(0)
    net = langid.Network.fresh(["a", "b", "c"], hidden=4, seed=1)
    for name in ("w", "u", "v", "c"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    x, y = r.integers(0, 256, (5, 6)).astype(np.uint8), r.integers(0, 3, 5)
    real = np.float32
    np.float32 = np.float64  # states in double precision for the comparison
    try:
        _, grads = net.gradients(x, y)
        for p, g in zip(net.parameters(), grads):
            for i in r.choice(p.size, 12, replace=False) if p.size > 12 else range(p.size):
                i = np.unravel_index(int(i), p.shape)
                keep, eps = p[i], 1e-5
                p[i] = keep + eps
                up = net.gradients(x, y)[0]
                p[i] = keep - eps
                down = net.gradients(x, y)[0]
                p[i] = keep
                assert (up - down) / (2 * eps) == pytest.approx(g[i], abs=1e-6, rel=1e-4)
    finally:
        np.float32 = real


ONE, TWO = ["tha", "ing", "wh", "er", "th"], ["keit", "sch", "ö", "ung", "pf"]


def _docs(n=160, seed=1):
    r = np.random.default_rng(seed)
    make = lambda parts: " ".join("".join(r.choice(parts, r.integers(1, 4))) for _ in range(r.integers(8, 40)))
    return [(i, make(TWO if i % 2 else ONE), "two" if i % 2 else "one", "s", 0) for i in range(n)]


def test_held_out_accuracy(documents):
    rows = _docs()
    got = {r["doc_id"]: r for r in langid.identify(documents(rows)).withColumn("out", langid.held_out("doc_id")).collect()}
    out = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i, r in got.items() if r["out"]} == set(out)
    assert np.mean([got[i]["lang_pred"] == rows[i][2] for i in out]) > 0.95
    assert all(0.5 < r["score"] <= 1 for r in got.values())


def test_labels_of_held_out_documents_teach_nothing(documents):
    rows = [(i, t, "never" if zlib.crc32(str(i).encode()) % 4 == 2 else lang, s, n) for i, t, lang, s, n in _docs()]
    assert set(langid.fit(documents(rows)).labels) == {"one", "two"}


def test_odd_rows(documents):
    net = langid.fit(documents(_docs()))
    rows = [(1, None), (2, ""), (3, "12 %% 3"), (4, "é"), (5, "x" * 1000 + "keitsch"), (6, "ing"), (6, "ing"), (None, "schung pfö"), (8, "ª")]
    got = langid.identify(documents(rows).selectExpr("*", "1 AS score", "'q' AS run"), net)
    assert "run" in got.columns
    by = sorted((r["doc_id"] or 0, r["lang_pred"], r["score"]) for r in got.collect())
    assert [b[1] for b in by if b[0] in (1, 2, 3)] == ["und"] * 3
    assert all(b[1] in ("one", "two") for b in by if b[0] not in (1, 2, 3))
    assert by[0][1] == "two" and [b for b in by if b[0] == 6][0] == [b for b in by if b[0] == 6][1]
    assert langid.identify(documents([(1, "a")]).where("false"), net).count() == 0


def test_nothing_labelled_and_one_label(documents):
    bare = documents([(i, "word", None, "s", 4) for i in range(8)])
    assert {(r["lang_pred"], r["score"]) for r in langid.identify(bare).collect()} == {("und", 0.0)}
    one = documents([(i, "word", "xx", "s", 4) for i in range(8)])
    assert {r["lang_pred"] for r in langid.identify(one).collect()} == {"xx"}
