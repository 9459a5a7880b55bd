"""Packing by power-of-two decomposition: no sequence crosses documents and none needs padding.

A document's tokens are cut into pieces of 2048 and then of the powers of two
that make up the rest. Pieces of one length form a bucket; each piece is a
sequence by itself.
"""

import unicodedata
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from layoutcheck.llm.shared import Scratch, batches_of, remembered, small_batches, task
from layoutcheck.llm.words import chunks

LONGEST = 2048
END_ID = 1
RANGES = 4096
#: Words, with and without punctuation, in a half of a worker's memory of ids.
REMEMBERED = 200_000

#: Lower-case letters that are one code point in every normal form.
_SIMPLE = "".join(chr(c) for c in (*range(0x61, 0x7B), *range(0xDF, 0xF7), *range(0xF8, 0x100)))
_ASCII_TAIL = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Words that a tokenizer of this kind tokenizes alike together, apart and without their last punctuation.
_PROBES = ["hello,", "world!", "don't", "1234.", "l'\u00e9t\u00e9;", "a-b", "(x)", "\u00fcber...", "zz9%", "Q&A", "\u0434\u0430,", "\u0958.", "\u4e2d\u6587", "x" * 40]


@lru_cache(1 << 16)
def _stands(c: str) -> bool:
    """Whether the normalizer leaves this letter or digit as it is, so that punctuation after it is tokenized apart."""
    return c.isalnum() and unicodedata.normalize("NFC", c.lower()) == c


class Words:
    """Ids of words as bytes. The tokenizer drops white space and never joins across it, so a text's ids are its words' ids.

    Words that are new are tokenized many at once. A word of letters is one word
    for the tokenizer too, so its ids end with the only id that ends a word.
    Words in use stay remembered; others go with the older half of the memory.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.ids, self.older = Tokenizer.from_file(path), {}, {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        # for words that its normalizer leaves alone and its pattern leaves whole
        self.simple = Tokenizer.from_file(path)
        self.simple.normalizer = normalizers.Sequence([])
        self.simple.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        probes = [p.encode().lower() for p in _PROBES]
        known = self.learn(set(probes))
        if self._one("  ".join(_PROBES).encode()) != b"".join(known[p] for p in probes):
            raise ValueError(f"{path}: not a tokenizer that splits at white space, lower-cases and ends words with </w>")

    def _one(self, word: bytes) -> bytes:
        return np.array(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids, np.uint32).tobytes()

    def _many(self, words: list[bytes]) -> None:
        if words:
            found = np.array(self.simple.encode(b" ".join(words).decode(), add_special_tokens=False).ids, np.uint32)
            ends = (4 * np.flatnonzero(self.ends[found]) + 4).tolist()
            if len(ends) == len(words):
                raw = found.tobytes()
                self.ids.update(zip(words, [raw[low:high] for low, high in zip([0, *ends], ends)]))

    def learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        """Ids by word, for these words at least.

        Punctuation at the end is tokenized apart from a letter or digit before it that the normalizer leaves alone.
        """
        if len(self.ids) > REMEMBERED:
            self.ids, self.older = {}, self.ids
        ids, older = self.ids, self.older
        new = [w for w in words if w not in ids]
        if older:
            again = {w: older[w] for w in new if w in older}
            ids.update(again)
            new = [w for w in new if w not in again]
        cores = [c if (c := w.rstrip(_ASCII_TAIL)) and (c[-1:].isalnum() or _stands(c.decode()[-1])) and b"<|" not in c else w for w in new]
        fresh = {c for c in cores if c not in ids}
        if older:
            ids.update([(c, older[c]) for c in fresh if c in older])
        self._many([c for c in fresh if c not in ids and not c.decode().strip(_SIMPLE)])
        for core in fresh:
            if core not in ids:
                ids[core] = self._one(core)
        for word, core in zip(new, cores):
            if word not in ids:
                tail = word[len(core) :]
                if tail not in ids:
                    ids[tail] = self._one(tail)
                ids[word] = ids[core] + ids[tail]
        return ids


def _words(path: str | None) -> Words:
    """A worker's words of a tokenizer; the next task finds them again."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return remembered("packing", path, lambda: Words(path))


def _folded(text: bytes) -> bytes:
    """A-Z in lower case, which the tokenizer does too, but for what might spell one of its special tokens."""
    return text if b"|>" in text else text.lower()


def lengths(n: int, longest: int = LONGEST) -> list[int]:
    """n as full pieces and then descending powers of two."""
    out = [longest] * (n // longest)
    rest = n % longest
    return out + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def _packer(path: str | None, end_id: int, longest: int, with_ids: bool):
    end = np.array([end_id], np.uint32).tobytes()

    def run(batches):
        known = _words(path)
        for batch in (part for whole in batches for part in chunks(whole, "text", 4 << 20)):
            source, start, length, crc, total, blobs = [], [], [], [], [], []
            texts = [_folded(t or b"").split() for t in batch.column("text").cast(pa.binary()).to_pylist()]
            ids_of = known.learn(set().union(*texts)).__getitem__
            for i, own in enumerate(texts):
                ids = b"".join([*map(ids_of, own), end])
                n, at = len(ids) // 4, 0
                for size in lengths(n, longest):
                    piece = ids[4 * at : 4 * (at + size)]
                    source.append(i)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(piece))
                    total.append(n)
                    if with_ids:
                        blobs.append(piece)
                    at += size
            columns = [np.array(x, np.int64) for x in (start, length, crc, total)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(source, pa.int64())), *(pa.array(c) for c in columns), *([pa.array(blobs, pa.binary())] if with_ids else [])],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else [])],
            )

    return run


def pack(docs: DataFrame, tokenizer_path: str | None = None, end_id: int = END_ID, longest: int = LONGEST, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece; ids (uint32, little-endian) if asked for.

    Sequence ids count from 0, the shortest bucket first. A null or empty text
    is the end id alone; a null id is kept; rows of one id and repeated rows are
    packed each for itself; other columns are ignored; an empty table gives no
    rows. Texts are cut after tokenizing as a whole, so long ones lose nothing.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    pieces = rows.mapInArrow(task(_packer(tokenizer_path, end_id, longest, with_ids), "packing"), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids)
    pieces = pieces.withColumn("range", F.pmod(F.xxhash64("doc_id", "ids_crc32", "start"), F.lit(RANGES)).cast("int"))  # with the id, so copies part
    with batches_of(docs.sparkSession, 1024):  # words are tokenized many at once; bytes bound the batch
        pieces = Scratch(docs.sparkSession, "packing").keep(pieces, "pieces")  # read twice
    # a dozen lengths times RANGES rows at most, whatever the input
    before = Window.orderBy("length", "range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.groupBy("length", "range").count().select("length", "range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__first"))
    own = Window.partitionBy("length", "range").orderBy("doc_id", "start", "ids_crc32")
    numbered = pieces.withColumn("__nth", F.row_number().over(own)).join(F.broadcast(offsets), ["length", "range"])
    return numbered.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("__first") + F.col("__nth") - 1).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *(["ids"] if with_ids else []))
