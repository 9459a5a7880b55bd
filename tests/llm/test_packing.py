import zlib
from collections import defaultdict

import numpy as np
import pytest

from layoutcheck.llm.packing import lengths, pack

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_lengths():
    assert lengths(0) == [] and lengths(1) == [1] and lengths(2048) == [2048]
    assert lengths(2 * 2048 + 1000) == [2048, 2048, 512, 256, 128, 64, 32, 8]
    assert all(sum(lengths(n)) == n for n in range(5000))


TEXTS = ["Hello, world! it's 1234 DON'T l'été", None, "", "ΣΑΣ. İstanbul ﬁn² ① x​y   z", " ".join(f"word{i}," for i in range(3000)), "éá áb.", "''s 't'll. <|endoftext|> $$$***", "a" * 5000, "..", "abc's; d'; (e)"]


def test_pieces_hold_every_id_once(documents, tokenizer):
    rows = list(enumerate(TEXTS))
    got = pack(documents(rows), with_ids=True).collect()
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
    for i, text in rows:
        want = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        own = sorted(by[i], key=lambda r: r["start"])
        assert np.concatenate([np.frombuffer(r["ids"], "<u4") for r in own]).tolist() == want
        assert [r["start"] for r in own] == [0, *np.cumsum([r["length"] for r in own])[:-1].tolist()]
        assert {r["doc_tokens"] for r in own} == {len(want)}
    assert all(r["length"] <= 2048 and r["length"] & (r["length"] - 1) == 0 and r["offset"] == 0 for r in got)
    assert sorted(r["sequence_id"] for r in got) == list(range(len(got)))
    assert [r["length"] for r in sorted(got, key=lambda r: r["sequence_id"])] == sorted(r["length"] for r in got)


def test_odd_rows(documents):
    got = pack(documents([(None, "a"), (1, "b"), (1, "b"), (1, "b c d")])).collect()
    assert len(got) == 4 and sum(r["length"] for r in got) == 2 + 2 + 2 + 4
    assert pack(documents([(1, "b")]).where("false")).count() == 0
    clash = documents([(1, "b")]).selectExpr("*", "3 AS length", "4 AS range", "5 AS start")
    assert [tuple(r)[:3] for r in pack(clash).collect()] == [(1, 0, 2)]


def test_words_that_normalization_changes_have_the_tokenizers_ids(tokenizer, monkeypatch):
    from layoutcheck.llm import packing

    known = packing.Words(public_tokenizers.path("word_bpe_49k.json"))
    letters = [c for c in map(chr, range(0x80, 0x3000)) if c.isalnum()] + list("\u0958\u09dc\u0130\ufb01\u00c5\u212b\uac00")
    words = [p % c for c in letters for p in ("x%s.", "%s,", "%s's!")]
    words = [w.encode().lower() for w in words]
    want = {w: np.array(e.ids, np.uint32).tobytes() for w, e in zip(words, tokenizer.encode_batch([w.decode() for w in words], add_special_tokens=False))}
    monkeypatch.setattr(packing, "REMEMBERED", 500)  # halves are forgotten again and again
    for low in range(0, len(words), 300):
        some = set(words[low : low + 300]) | set(words[:20])
        ids = known.learn(some)
        assert all(ids[w] == want[w] for w in some)


def test_another_kind_of_tokenizer_is_refused():
    from layoutcheck.llm import packing

    with pytest.raises(ValueError):
        packing.Words(public_tokenizers.path("byte_bpe_50k.json"))


def test_copies_are_numbered_apart(documents):
    got = pack(documents([(i, "one same text") for i in range(300)])).collect()
    assert sorted(r["sequence_id"] for r in got) == list(range(len(got)))
