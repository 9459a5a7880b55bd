"""Each stage, run on what its predecessor kept, against a plain version."""

import random
import zlib

import pytest
from test_ngram_join import brute as near
from test_substring import brute as repeats

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from plain_mix import targets  # noqa: E402
from layoutcheck.llm.packing import lengths  # noqa: E402


def corpus():
    r = random.Random(9)
    parts = {"one": ["tha", "ing", "wh", "er", "th"], "two": ["keit", "sch", "ö", "ung", "pf"]}
    word = lambda lang: "".join(r.choice(parts[lang]) for _ in range(r.randint(1, 4)))
    passage = [word("one") for _ in range(25)]
    rows = []
    for i in range(150):
        lang = r.choice(["one", "two"])
        own = [word(lang) for _ in range(r.randint(5, 90))]
        if i % 9 == 0:
            own += passage
        rows.append((i, "\n".join(own), lang, f"s{i % 4}", 0))
    for i in range(150, 170):  # copies and near copies
        own = rows[i - 120][1].split()
        if i % 2 and len(own) > 60:
            own[-1] = word("one")
        rows.append((i, " ".join(own), "one", "s9", 0))
    rows += [(200, "12 34 %%", "one", "s1", 8), (201, None, "two", "s1", 0), (202, "", None, None, 0), (203, rows[0][1], "one", None, 0)]
    r.shuffle(rows)
    return [(i, t, lang, s, len(t or "")) for i, t, lang, s, _ in rows]


def keyed(df):
    assert df.columns == corpus_pipeline.COLUMNS
    return {r["doc_id"]: tuple(r) for r in df.collect()}


def test_stages(spark, documents, tmp_path):
    rows = corpus()
    documents(rows).write.parquet(str(tmp_path / "in/documents.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "in/documents.parquet")), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path / "in")).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append(docs)
    start = {r[0]: r for r in rows}
    language = keyed(kept[0])
    assert language == {i: r for i, r in start.items() if i not in (200, 201, 202)}

    groups = near([(i, r[1]) for i, r in language.items()])
    unique = keyed(kept[1])
    assert unique == {i: r for i, r in language.items() if groups[i][1] == i} and len(unique) < len(language)

    cut = {i: (n, gone, text) for i, n, gone, text in repeats([(i, r[1]) for i, r in unique.items()], 13)}
    want = {i: (i, r[1] if not cut[i][1] else cut[i][2], r[2], r[3], len(r[1] if not cut[i][1] else cut[i][2])) for i, r in unique.items() if cut[i][1] < cut[i][0]}
    passages = keyed(kept[2])
    assert passages == want and any(gone for _, gone, _ in cut.values())

    size = {i: len(r[1].split()) for i, r in passages.items()}
    sources = {r[3] for r in passages.values()}
    goal = targets({s: sum(size[i] for i, r in passages.items() if r[3] == s) for s in sources})
    mixed = [tuple(r) for r in kept[3].collect()]
    assert all(r == passages[r[0]] for r in mixed)
    for s in sources:
        assert abs(sum(size[r[0]] for r in mixed if r[3] == s) - goal[s]) <= max(size[i] for i in size)

    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = []
    for r in mixed:
        ids, at = tokenizer.encode(r[1], add_special_tokens=False).ids + [1], 0
        for n in lengths(len(ids)):
            pieces.append((r[0], at, n, zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[at : at + n])), len(ids)))
            at += n
    assert sorted(tuple(r)[:5] for r in kept[4].collect()) == sorted(pieces)
    whole = corpus_pipeline.run(spark, str(tmp_path / "in"))
    assert sorted(tuple(r)[:5] for r in whole.collect()) == sorted(pieces)


def test_an_empty_table(spark, documents, tmp_path):
    documents([(1, "a")]).where("false").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_repeated_rows_of_one_id(spark, documents):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    docs = documents([(1, a), (1, a), (1, b), (2, b), (None, b), (3, "%"), (3, "%")])
    got = sorted((r["doc_id"], r["text"]) for r in corpus_pipeline.near_copies(spark, docs, "").collect())
    assert got == [(1, a), (1, b), (3, "%")]


def test_near_copies_are_of_five_words_and_four_fifths(spark, documents):
    r = random.Random(4)
    texts = [[f"w{r.randrange(10**6)}" for _ in range(200)] for _ in range(8)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    for i, t in enumerate(texts):  # 5-word similarity 176/216 with four words changed, 171/221 with five
        own = list(t)
        for k in range(4 + i % 2):
            own[20 + 35 * k] = f"new{i}x{k}"
        rows.append((100 + i, " ".join(own)))
    rows += [(200 + i, " ".join(t + [f"more{i}x{k}" for k in range(n)])) for i, (t, n) in enumerate(zip(texts, (30, 49, 50, 60)))]
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    linked = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    least = {i: i for i in sets}
    while any(least[a] != least[b] for a in sets for b in sets if linked(a, b)):
        least = {a: min(least[b] for b in sets if linked(a, b)) for a in sets}
    got = sorted(x["doc_id"] for x in corpus_pipeline.near_copies(spark, documents(rows), "").collect())
    assert got == sorted(i for i, first in least.items() if first == i)
    assert {100, 102, 200, 201}.isdisjoint(got) and {101, 103, 203} <= set(got)
