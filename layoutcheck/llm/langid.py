"""Language of documents by a bidirectional gated recurrent network over bytes.

The network reads the bytes of the whole text, white space included, in both
directions and gives every position probabilities of the languages; a
document's are the mean over all its positions. Long texts are read in pieces
that overlap: in either direction a piece begins with the WARM bytes before it,
which fill its state and are labelled by the piece they belong to. The network
is trained in numpy by backpropagation through time, on a bounded sample of
labelled documents.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layoutcheck.llm.shared import small_batches, task
from layoutcheck.llm.words import chunks, column

#: Labelled documents of a language to learn from (about), and passages of CROP bytes drawn from the whole of each.
DOCS_A_LANGUAGE, CROPS_A_DOCUMENT, CROP = 400, 6, 64
HIDDEN, EPOCHS, BATCH, RATE = 8, 3, 128, 0.03
#: Positions that a piece of a text labels, and bytes that it reads before and after them.
PIECE, WARM = 256, 32
#: Pieces that the network reads side by side.
SIDE_BY_SIDE = 1024
#: Stands for no byte, before and after a text; an empty state stays empty there.
NOTHING = 256
UNKNOWN = "und"


def _bend(x: np.ndarray) -> np.ndarray:
    """The network's bounded unit, between -1 and 1; its slope at y = _bend(x) is (1 - abs(y))**2. A gate is (1 + _bend(x)) / 2.

    It takes a sixth of the time of a tanh, on which most time would go.
    """
    return x / (1 + np.abs(x))


@dataclass
class Network:
    """w: (direction, byte or NOTHING, 3H) inputs; u: (direction, H, 3H) recurrent; v: (2H, L), c: (L) to the labels. Gates: update, reset, new."""

    labels: list[str]
    w: np.ndarray
    u: np.ndarray
    v: np.ndarray
    c: np.ndarray

    @classmethod
    def fresh(cls, labels: list[str], hidden: int = HIDDEN, seed: int = 5) -> "Network":
        r = np.random.default_rng(seed)
        draw = lambda *shape, s: (r.standard_normal(shape) * s).astype(np.float32)
        w = draw(2, NOTHING + 1, 3 * hidden, s=0.3)
        w[:, NOTHING] = 0
        return cls(labels, w, draw(2, hidden, 3 * hidden, s=hidden**-0.5), draw(2 * hidden, len(labels), s=0.3), np.zeros(len(labels), np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [self.w, self.u, self.v, self.c]

    def _run(self, x: np.ndarray, way: int, keep: list | None):
        """States (steps, rows, H) of one direction over bytes x (rows, steps)."""
        h_size = self.u.shape[1]
        h = np.zeros((len(x), h_size), np.float32)
        states = np.empty((x.shape[1], len(x), h_size), np.float32)
        steps = range(x.shape[1]) if way == 0 else range(x.shape[1] - 1, -1, -1)
        for t in steps:
            a, b = self.w[way][x[:, t]], h @ self.u[way]
            gates = 0.5 + 0.5 * _bend(a[:, : 2 * h_size] + b[:, : 2 * h_size])
            z, r = gates[:, :h_size], gates[:, h_size:]
            n = _bend(a[:, 2 * h_size :] + r * b[:, 2 * h_size :])
            if keep is not None:
                keep.append((t, h, z, r, n, b[:, 2 * h_size :]))
            h = n + z * (h - n)
            states[t] = h
        return states

    def probabilities(self, x: np.ndarray, keep: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(steps, rows, labels) probabilities at every position, and the states."""
        both = np.concatenate([self._run(x, way, keep[way] if keep else None) for way in (0, 1)], axis=2)
        logits = both @ self.v + self.c
        logits -= logits.max(axis=2, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=2, keepdims=True)
        return logits, both

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross entropy over all positions of texts, and its derivatives by backpropagation through time."""
        keep: tuple[list, list] = ([], [])
        p, both = self.probabilities(x, keep)
        rows, h_size = len(x), self.u.shape[1]
        real = (x != NOTHING).T
        count = max(int(real.sum()), 1)
        right = p[:, np.arange(rows), y]
        loss = float(-(np.log(np.maximum(right, 1e-12)) * real).sum() / count)
        d = p
        d[:, np.arange(rows), y] -= 1
        d *= (real / count).astype(d.dtype)[:, :, None]
        dv, dc = np.tensordot(both, d, ([0, 1], [0, 1])), d.sum((0, 1))
        dboth = d @ self.v.T
        dw, du = np.zeros_like(self.w), np.zeros_like(self.u)
        for way in (0, 1):
            dh = np.zeros((rows, h_size), np.float32)
            for t, h, z, r, n, b in reversed(keep[way]):
                dh = dh + dboth[t, :, way * h_size : (way + 1) * h_size]
                dn = dh * (1 - z) * (1 - np.abs(n)) ** 2
                dz = dh * (h - n) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
                dr = dn * b * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
                da = np.concatenate((dz, dr, dn), axis=1)
                db = np.concatenate((dz, dr, dn * r), axis=1)
                np.add.at(dw[way], x[:, t], da)
                du[way] += h.T @ db
                dh = dh * z + db @ self.u[way].T
            dw[way, NOTHING] = 0
        return loss, [dw, du, dv, dc]


class Reader:
    """The same network laid out for reading many pieces: (unit, piece) arrays, used again at every step."""

    def __init__(self, net: Network):
        h = net.u.shape[1]
        self.h, self.labels = h, len(net.labels)
        self.w = [np.ascontiguousarray(w.T) for w in net.w]
        self.u = [np.ascontiguousarray(u.T) for u in net.u]
        self.v = [np.ascontiguousarray(net.v[:h].T), np.ascontiguousarray(net.v[h:].T)]
        self.c = net.c[:, None]

    def _states(self, x: np.ndarray, way: int):
        """(step, states) of one direction over bytes x (steps, pieces)."""
        h, size = self.h, x.shape[1]
        state, (a, b, c) = np.zeros((h, size), np.float32), np.empty((3, 3 * h, size), np.float32)

        def bend(y, spare):
            np.abs(y, out=spare)
            spare += 1
            y /= spare

        for t in range(len(x)) if way == 0 else range(len(x) - 1, -1, -1):
            np.take(self.w[way], x[t], axis=1, out=a, mode="clip")
            np.matmul(self.u[way], state, out=b)
            gates, new = a[: 2 * h], b[2 * h :]
            gates += b[: 2 * h]
            bend(gates, c[: 2 * h])
            gates *= 0.5
            gates += 0.5
            new *= gates[h:]
            new += a[2 * h :]
            bend(new, c[2 * h :])
            state -= new
            state *= gates[:h]
            state += new
            yield t, state

    def sums(self, x: np.ndarray, own: np.ndarray) -> np.ndarray:
        """(labels, pieces): probabilities summed over each piece's own positions."""
        logits = np.empty((len(x), self.labels, x.shape[1]), np.float32)
        for t, state in self._states(x, 0):
            np.matmul(self.v[0], state, out=logits[t])
        total = np.zeros((self.labels, x.shape[1]))
        for t, state in self._states(x, 1):
            p = logits[t]
            p += self.v[1] @ state
            p += self.c
            np.exp(p, out=p)  # states are below 1, so no sum of theirs overflows
            p *= own[t] / p.sum(0)
            total += p
        return total

    def mean(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(texts, labels): mean probabilities over all bytes of each text; 0 for an empty one."""
        size = np.diff(offsets)
        pieces = -(-size // PIECE)
        text = np.repeat(np.arange(len(size)), pieces)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = offsets[text] + nth * PIECE
        before = np.where(nth > 0, WARM, 0)
        count = np.minimum(PIECE, offsets[text + 1] - start)
        end = np.minimum(start + count + WARM, offsets[text + 1])
        order = np.argsort(before + end - start, kind="stable")
        total = np.zeros((len(size), self.labels))
        for low in range(0, len(order), SIDE_BY_SIDE):
            some = order[low : low + SIDE_BY_SIDE]
            lead, at = before[some], (start - before)[some]
            steps = np.arange(int((lead + (end - start)[some]).max()))[:, None]
            place = at + steps
            x = np.where(place < end[some], data[np.minimum(place, len(data) - 1)].astype(np.intp), NOTHING)
            own = (steps >= lead) & (steps < lead + count[some])
            np.add.at(total, text[some], self.sums(x, own).T)
        return total / np.maximum(size, 1)[:, None]


def train(crops: list[bytes], langs: list[str], hidden: int = HIDDEN, epochs: int = EPOCHS, seed: int = 5) -> Network:
    """Fits a network by Adam. A crop that is shorter than the longest is followed by nothing."""
    labels = sorted(set(langs))
    net = Network.fresh(labels, hidden, seed)
    crops, langs = zip(*[(c, s) for c, s in zip(crops, langs) if c]) if any(crops) else ((), ())
    if len(labels) < 2 or not crops:
        return net
    x = np.full((len(crops), max(map(len, crops))), NOTHING, np.int64)
    for row, crop in zip(x, crops):
        row[: len(crop)] = np.frombuffer(crop, np.uint8)
    index = {s: i for i, s in enumerate(labels)}
    y = np.array([index[s] for s in langs])
    rng, step = np.random.default_rng(seed), 0
    first, second = [np.zeros_like(p) for p in net.parameters()], [np.zeros_like(p) for p in net.parameters()]
    parts = -(-len(y) // BATCH)
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(y)), parts):
            _, grads = net.gradients(x[part], y[part])
            step += 1
            rate = RATE * (1 - 0.95 * step / (epochs * parts))
            for p, g, m, s in zip(net.parameters(), grads, first, second):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                p -= (rate / (1 - 0.9**step)) * m / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return net


def _drawer(count: int, length: int):
    def run(batches):
        for batch in batches:
            crops, langs = [], []
            for text, lang, seed in zip(batch.column("text").cast(pa.binary()), batch.column("lang").to_pylist(), batch.column("h").to_pylist()):
                own = text.as_py() or b""
                at = np.random.default_rng(seed & (2**63 - 1)).integers(0, max(len(own) - length, 0) + 1, min(count, -(-len(own) // length)))
                crops += [own[i : i + length] for i in at.tolist()]
                langs += [lang] * len(at)
            yield pa.RecordBatch.from_arrays([pa.array(crops, pa.binary()), pa.array(langs, pa.string())], ["crop", "lang"])

    return run


def _predictor(sent, columns: list[str], text: str = "__text"):
    def run(batches):
        net = sent.value
        labels, reader = net.labels, Reader(net)
        for batch in (part for whole in batches for part in chunks(whole, text, 1 << 20)):
            on = np.asarray(pc.match_substring_regex(batch.column(text).fill_null(""), r"\p{L}")).astype(bool)
            names, scores = np.full(batch.num_rows, UNKNOWN, object), np.zeros(batch.num_rows)
            if labels and on.any():
                mean = reader.mean(*column(batch.column(text).filter(pa.array(on))))
                best = mean.argmax(1)
                names[on] = np.array(labels, object)[best]
                scores[on] = np.clip(mean[np.arange(len(best)), best], 0, 1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*columns, "lang_pred", "score"])

    return run


def held_out(id_col: str) -> F.Column:
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_a_language: int = DOCS_A_LANGUAGE, crops_a_document: int = CROPS_A_DOCUMENT, crop: int = CROP) -> Network:
    """A network that has learned from labelled documents that are not held out.

    About ``docs_a_language`` documents of each language are drawn by a hash of
    their id, and at most ``crops_a_document`` passages of ``crop`` bytes from
    the whole text of each, so the driver gets a bounded sample whatever the
    input: documents, passages and bytes have their bounds. Held-out rows and
    rows without a label teach nothing. There must be one row a language on the
    driver.
    """
    small_batches(docs.sparkSession)
    h = F.xxhash64(F.lit("langid"), F.col(f"`{id_col}`"))
    known = docs.where(~held_out(id_col) & F.col(f"`{lang_col}`").isNotNull()).select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"), h.alias("h"))
    share = {r[0]: min(1.0, docs_a_language / r[1]) for r in known.groupBy("lang").count().collect()}
    if not share:
        return Network.fresh([])
    most = F.create_map(*(F.lit(x) for lang, p in share.items() for x in (lang, int(p * (1 << 31)))))
    drawn = known.where(F.pmod("h", F.lit(1 << 31)) < F.element_at(most, F.col("lang"))).mapInArrow(task(_drawer(crops_a_document, crop)), "crop binary, lang string").toArrow()
    pairs = sorted(zip(drawn.column("crop").to_pylist(), drawn.column("lang").to_pylist()))
    net = train([r for r, _ in pairs], [s for _, s in pairs])
    net.labels = net.labels or sorted(share)
    return net


def identify(docs: DataFrame, net: Network | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs with lang_pred and score; fits a network first unless one is given.

    Only the text is read to predict, whole. A null text or one without a letter is
    ``und`` with score 0, and so is every text if nothing is labelled; with one
    learned language all texts with a letter get it. Null ids count as the empty
    string where rows are held out from learning. Repeated rows get equal
    results; other columns pass, but for those named as the results, which are
    replaced; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    net = net or fit(docs, id_col, text_col, lang_col)
    small_batches(spark)
    columns = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = docs.select(*(F.col(f"`{c}`") for c in columns)).schema.add("lang_pred", "string").add("score", "double")
    rows = docs.select(*(F.col(f"`{c}`") for c in dict.fromkeys([*columns, text_col])))
    return rows.mapInArrow(task(_predictor(spark.sparkContext.broadcast(net), columns, text_col)), schema)
