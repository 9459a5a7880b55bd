import hashlib
import random

import pytest

from layoutcheck.llm import substring
from layoutcheck.llm.substring import remove_repeats


def brute(rows, k):
    own = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in own:
        for a in range(len(w) - k + 1):
            key = tuple(w[a : a + k])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in own:
        gone = set()
        for a in range(len(w) - k + 1):
            if first[tuple(w[a : a + k])] < i:
                gone.update(range(a, a + k))
        out.append((i, len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    return sorted(out)


def result(df):
    return sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in df.collect())


def corpus(seed, n=120):
    r = random.Random(seed)
    word = lambda: f"w{r.randint(0, 400)}"
    passage = [word() for _ in range(30)]
    rows = []
    for i in range(n):
        body = [word() for _ in range(r.randint(0, 60))]
        if r.random() < 0.4:
            cut = r.randint(0, 20)
            at = r.randint(0, len(body))
            body[at:at] = passage[cut : cut + r.randint(10, 30)]
        if r.random() < 0.1:
            body += ["same"] * 30
        rows.append((i * 3 - 50, r.choice([" ", "\n", "  \t"]).join(body)))
    rows += [(1000 + i, rows[7][1]) for i in range(5)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "k", "block"), [(1, 13, None), (2, 13, 40), (3, 4, 100)])
def test_removal_is_the_brute_force(documents, monkeypatch, seed, k, block):
    if block:
        monkeypatch.setattr(substring, "BLOCK", block)
    rows = corpus(seed)
    assert result(remove_repeats(documents(rows), k=k)) == brute(rows, k)


def test_a_full_sketch_changes_no_result(documents):
    rows = corpus(4)
    assert result(remove_repeats(documents(rows), sketch_bytes=1 << 18)) == brute(rows, 13)


def test_odd_rows(documents):
    p = " ".join(f"p{i}" for i in range(13))
    rows = [(1, None), (2, ""), (3, p), (4, p + " tail"), (5, "x " + p), (6, " ".join(p.split()[:12])), (7, p.upper())]
    assert result(remove_repeats(documents(rows))) == brute(rows, 13)
    same = documents([(4, p), (4, p + " more"), (4, p + " more"), (9, p)])
    assert result(remove_repeats(same)) == [(4, 13, 0, p), (4, 14, 0, p + " more"), (4, 14, 0, p + " more"), (9, 13, 13, "")]
    null = remove_repeats(documents([(None, p), (1, p)])).collect()
    assert sorted((r["n_removed"] for r in null)) == [0, 0]
    assert remove_repeats(documents([(1, p)]).where("false")).count() == 0
    clash = remove_repeats(documents([(1, p), (2, p)]).selectExpr("*", "'x' AS bucket", "7 AS n_words", "'y' AS kept_text", "1 AS `a b`"))
    assert result(clash) == [(1, 13, 0, p), (2, 13, 13, "")]
    assert {"bucket", "a b"} <= set(clash.columns)


def test_query_matches_sql(spark, tmp_path, documents):
    import duckdb
    from layoutcheck.llm.queries import ORACLES, QUERIES

    documents(corpus(5)).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in QUERIES["op7_substring_dedup"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(con.execute(ORACLES["op7_substring_dedup"]).fetchall())
    assert got[0][3] == hashlib.sha256(brute(corpus(5), 13)[0][3].encode()).hexdigest()
