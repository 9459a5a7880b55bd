import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from layoutcheck.llm import sketch, words

TEXT = st.text(alphabet=st.sampled_from("ab Z\t\n\x0b\x0c\r é 😀"), max_size=30)


def _plain(texts, lower):
    fold = bytes(range(256)).lower() if lower else bytes(range(256))
    return [t.encode().translate(fold).split() if t is not None else [] for t in texts]


@settings(deadline=None, max_examples=60)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=6), st.booleans())
def test_words_are_those_of_split_and_equal_hashes_are_equal_words(texts, lower):
    h, first = words.hashes(*words.column(pa.array(texts, pa.string())), lower=lower)
    want = _plain(texts, lower)
    assert np.diff(first).tolist() == [len(w) for w in want]
    flat = [w for own in want for w in own]
    assert len(set(h.tolist())) == len(set(flat))
    assert len(set(zip(h.tolist(), flat))) == len(set(flat))


@settings(deadline=None, max_examples=40)
@given(st.lists(TEXT, max_size=5), st.integers(1, 4))
def test_windows_stay_inside_a_text(texts, k):
    h, first = words.hashes(*words.column(pa.array(texts, pa.string())))
    runs, text, at = words.windows(h, first, k)
    want = [(i, j, tuple(w[j : j + k])) for i, w in enumerate(_plain(texts, False)) for j in range(len(w) - k + 1)]
    assert [(int(i), int(j)) for i, j in zip(text, at)] == [w[:2] for w in want]
    assert len({(int(r), w[2]) for r, w in zip(runs, want)}) == len({w[2] for w in want}) == len(set(runs.tolist()))


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    text = " ".join(f"w{i % 700}" for i in range(3000)) + " " + "x" * 5000 + " end"
    whole = words.hashes(*words.column(pa.array([text, "w5"])))[0]
    monkeypatch.setattr(words, "PIECE", 512)
    assert (words.hashes(*words.column(pa.array([text, "w5"])))[0] == whole).all()
    assert whole[5] == whole[705] == whole[-1]


def test_slices_of_batches_keep_their_rows():
    batch = pa.record_batch({"t": pa.array(["a" * 10, None, "b" * 50, "c", "d" * 9])})
    parts = list(words.chunks(batch, "t", 20))
    assert pa.Table.from_batches(parts).column("t").to_pylist() == batch.column("t").to_pylist()
    assert [p.num_rows for p in parts] == [2, 1, 2]


@pytest.mark.parametrize("bits", [20, 22])
def test_no_repeated_key_fails_the_sketch(bits):
    r = np.random.default_rng(1)
    blocks = [r.integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2) for _ in range(3)]
    blocks[2][:100] = blocks[0][:100]
    blocks[1][:50] = blocks[1][50:100]
    filled = np.zeros((sketch.ROWS << bits - sketch.SLICE, 1 << sketch.SLICE), np.uint8)
    for b in blocks:
        for i, once, twice in sketch.block(b, bits):
            sketch.add(filled[i], once, twice)
    table = np.frombuffer(b"".join(map(sketch.bits, filled)), np.uint8).reshape(sketch.ROWS, -1)
    assert sketch.passes(blocks[0][:100], bits, table).all()
    assert sketch.passes(blocks[1][:100], bits, table).all()
    assert sketch.passes(blocks[0][100:], bits, table).mean() < 0.1


def test_gaps_round_trip():
    cells = np.array([0, 1, 254, 255, 256, 510, 511, 2000, 1 << 19], np.uint32)
    assert sketch.unpack(sketch.pack(cells)).tolist() == cells.tolist()
    assert sketch.unpack(sketch.pack(cells[:0])).tolist() == []


def _thue_morse(n, a, b):
    return "".join((a, b)[i.bit_count() & 1] for i in range(n))


@pytest.mark.parametrize("n", [64, 512, 1024, 2048, 4096])
def test_words_that_collide_in_polynomials_do_not_collide(n):
    pair = [_thue_morse(n, "a", "b"), _thue_morse(n, "b", "a"), "a" * n, "a" * (n + 1), "a" * (n - 1) + "\0"]
    for salt in (0, 1):
        h = words.hashes(*words.column(pa.array([" ".join(pair)])), salt=salt)[0]
        assert len(set(h.tolist())) == len(pair)


@pytest.mark.parametrize("k", [2, 4, 8, 13, 16])
def test_runs_that_collide_in_polynomials_do_not_collide(k):
    text = [_thue_morse(16, "x ", "y "), _thue_morse(16, "y ", "x ")]
    h, first = words.hashes(*words.column(pa.array(text)))
    runs, of, at = words.windows(h, first, k)
    want = [tuple(text[i].split()[j : j + k]) for i, j in zip(of, at)]
    assert len(set(runs.tolist())) == len(set(want)) == len(set(zip(runs.tolist(), want)))
    assert not set(runs.tolist()) & set(words.run_hashes(words.hashes(*words.column(pa.array(text)), salt=1)[0], k, salt=1).tolist())
