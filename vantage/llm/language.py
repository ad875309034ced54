"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time. It labels every byte position of a text; a document's
probabilities are the mean over all its positions. A text is read in spans of ``SPAN`` bytes, as in training: both
directions start anew in each span, so a position knows its span from both sides and nothing beyond it. Gates are
piecewise linear.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantage.llm.storage import documents, held_out
from vantage.llm.words import gather_index, slices, text_bytes

#: Training documents of each language at most; the only bound on what the model is fitted to.
SAMPLE_PER_LANG = 400
HIDDEN = 8
SPAN = 128
LANES = 4096
UNKNOWN = "und"


@dataclass
class Direction:
    """One gated recurrent layer. ``table`` holds the input part of the three gates for each byte value (and one for padding)."""

    table: np.ndarray  # (3 * hidden, 257)
    inner: np.ndarray  # (3 * hidden, hidden)

    def step(self, byte: np.ndarray, h: np.ndarray, keep: list | None = None) -> np.ndarray:
        n = len(self.inner) // 3
        a = np.take(self.table, byte, axis=1)
        u = self.inner @ h
        gates = a[: 2 * n] + u[: 2 * n]
        gates += np.float32(0.5)
        np.clip(gates, 0, 1, out=gates)  # piecewise linear gates: update z, reset r
        z, r = gates[:n], gates[n:]
        c = np.tanh(a[2 * n :] + r * u[2 * n :])
        if keep is not None:
            keep.append((byte, h, u[2 * n :], gates, c))
        return c + z * (h - c)

    def backward(self, kept: list, grads: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of ``table`` and ``inner`` from those of the states, through all steps from the last."""
        n = len(self.inner) // 3
        d_table, d_inner = np.zeros_like(self.table), np.zeros_like(self.inner)
        inputs = []
        dh = np.zeros_like(grads[0])
        for (byte, h, un, gates, c), grad in zip(reversed(kept), reversed(grads), strict=True):
            dh = dh + grad
            z, r = gates[:n], gates[n:]
            dc = dh * (1 - z) * (1 - c * c)
            live = (gates > 0) & (gates < 1)
            dz, dr = dh * (h - c) * live[:n], dc * un * live[n:]
            da = np.concatenate([dz, dr, dc])
            du = np.concatenate([dz, dr, dc * r])
            inputs.append((byte, da))
            d_inner += du @ h.T
            dh = dh * z + self.inner.T @ du
        read, da = np.concatenate([b for b, _ in inputs]), np.concatenate([d for _, d in inputs], axis=1)
        for row in range(3 * n):
            d_table[row] = np.bincount(read, da[row], minlength=d_table.shape[1])
        return d_table, d_inner


@dataclass
class Model:
    langs: list[str]
    left: Direction
    right: Direction
    out: np.ndarray  # (classes, 2 * hidden + 1)

    def params(self) -> list[np.ndarray]:
        return [self.left.table, self.left.inner, self.right.table, self.right.inner, self.out]

    def positions(self, spans: np.ndarray, valid: np.ndarray) -> np.ndarray:
        """Sum over the valid positions of each span of the class probabilities: (classes, spans). ``spans`` is (time, lanes)."""
        steps, lanes = spans.shape
        n = self.left.inner.shape[1]
        h, states = np.zeros((n, lanes), np.float32), np.empty((steps, n, lanes), np.float32)
        for t in range(steps):
            h = states[t] = self.left.step(spans[t], h)
        h, total = np.zeros((n, lanes), np.float32), np.zeros((len(self.langs), lanes), np.float32)
        from_left, from_right, bias = self.out[:, :n], self.out[:, n : 2 * n], self.out[:, 2 * n :]
        full = bool((valid >= steps).all())
        for t in range(steps - 1, -1, -1):
            h = self.right.step(spans[t], h)
            if not full:
                inside = valid > t
                h *= inside
            p = from_left @ states[t] + from_right @ h + bias
            p -= p.max(axis=0)
            np.exp(p, out=p)
            p /= p.sum(axis=0)
            total += p if full else p * inside
        return total


def train(texts: list[bytes], labels: list[str], hidden: int = HIDDEN, steps: int = 300, batch: int = 96, span: int = SPAN, seed: int = 11) -> Model:
    """Fit on spans drawn uniformly over the bytes of each document; every language is drawn equally often."""
    rng = np.random.default_rng(seed)
    langs = sorted(set(labels))

    def layer() -> Direction:
        return Direction(rng.normal(0, 0.3, (3 * hidden, 257)).astype(np.float32), rng.normal(0, 0.3, (3 * hidden, hidden)).astype(np.float32))

    model = Model(langs, layer(), layer(), rng.normal(0, 0.3, (len(langs), 2 * hidden + 1)).astype(np.float32))
    by_lang = [[np.frombuffer(t, np.uint8) for t, x in zip(texts, labels, strict=True) if x == lang and len(t) > 0] for lang in langs]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in model.params()]
    for step in range(1, steps + 1):
        y = rng.integers(0, len(langs), batch)
        spans = np.full((batch, span), 256, np.int64)
        for i, k in enumerate(y):
            if by_lang[k]:
                text = by_lang[k][rng.integers(0, len(by_lang[k]))]
                a = int(rng.integers(0, max(1, len(text) - span + 1)))
                spans[i, : len(text[a : a + span])] = text[a : a + span]
        x = spans.T
        grads = gradients(model, x, y)
        rate = 0.01 * min(1.0, 2.5 * (1 - step / (steps + 1)))
        for p, g, (m, v) in zip(model.params(), grads, moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


def gradients(model: Model, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Gradients of the mean cross-entropy over all positions, by backpropagation through time in both directions."""
    steps, lanes = x.shape
    n, classes = model.left.inner.shape[1], len(model.langs)
    valid = x < 256
    kept_left: list = []
    kept_right: list = []
    h, lefts = np.zeros((n, lanes), np.float32), []
    for t in range(steps):
        h = model.left.step(x[t], h, kept_left)
        lefts.append(h)
    h, rights = np.zeros((n, lanes), np.float32), [None] * steps
    for t in range(steps - 1, -1, -1):
        h = rights[t] = model.right.step(x[t], h, kept_right) * valid[t]
    target = np.eye(classes, dtype=np.float32)[:, y]
    d_out, d_left, d_right = np.zeros_like(model.out), [], []
    scale = np.float32(1 / max(1, valid.sum()))
    for t in range(steps):
        both = np.concatenate([lefts[t], rights[t], np.ones((1, lanes), np.float32)])
        p = model.out @ both
        p = np.exp(p - p.max(axis=0))
        d = (p / p.sum(axis=0) - target) * (valid[t] * scale)
        d_out += d @ both.T
        back = model.out.T @ d
        d_left.append(back[:n])
        d_right.append(back[n : 2 * n])
    left = model.left.backward(kept_left, d_left)
    right = model.right.backward(kept_right, d_right[::-1])
    return [*left, *right, d_out]


def training_sample(table: DataFrame, per_lang: int = SAMPLE_PER_LANG, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, str]]:
    """Up to ``per_lang`` whole texts of each language among the rows that may be learned from, drawn by a hash of the id."""
    rows = table.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    draw = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(3)), F.lit(1 << 20))
    counts = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}
    limit = F.lit(0)
    for lang, n in counts.items():
        limit = F.when(F.col(lang_col) == lang, F.lit(min(1 << 20, int((1 << 20) * 1.5 * per_lang / n) + 1))).otherwise(limit)
    drawn = rows.where(draw < limit).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col).cast("string"), F.lit(3)).alias("h")).collect()
    held: dict[str, list] = {}
    for r in sorted(drawn, key=lambda r: r["h"] % (1 << 20)):
        mine = held.setdefault(r["lang"], [])
        if len(mine) < per_lang:
            mine.append(r["text"])
    return [(t, lang) for lang in sorted(held) for t in held[lang]]


def fit(table: DataFrame, per_lang: int = SAMPLE_PER_LANG) -> Model | None:
    sample = training_sample(table, per_lang)
    return train([t.encode() for t, _ in sample], [x for _, x in sample]) if sample else None


def document_probabilities(model: Model, raw: np.ndarray, at: np.ndarray, span: int = SPAN, lanes: int = LANES) -> np.ndarray:
    """Mean class probabilities over all bytes of each document, (documents, classes); zeros for an empty one."""
    size = np.diff(at)
    n = -(-size // span)
    doc = np.repeat(np.arange(len(size)), n)
    start = at[:-1][doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * span
    valid = np.minimum(span, at[1:][doc] - start)
    order = np.argsort(-valid, kind="stable")  # full spans first: their blocks need no mask
    out = np.zeros((len(size), len(model.langs)))
    for row in range(0, len(order), lanes):
        pick = order[row : row + lanes]
        spans = np.full((len(pick), span), 256, np.int16)
        index, _ = gather_index(start[pick], valid[pick])
        spans[np.arange(span) < valid[pick][:, None]] = raw[index]
        np.add.at(out, doc[pick], model.positions(np.ascontiguousarray(spans.T), valid[pick]).T)
    return out / np.maximum(size, 1)[:, None]


def predict(table: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """All columns of ``table`` and ``lang_pred`` and ``score``, for every row.

    A text that is null or has no letter is ``und`` with score 0, and so is every text if nothing could be learned.
    Ties go to the language first in the alphabet. Repeated rows are judged each for itself; columns of the input that are
    named like a result are replaced.
    """
    table = table.drop("lang_pred", "score")
    place = table.columns.index(text_col)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col):
            text = part.column(place)
            known = np.array([any(map(str.isalpha, t or "")) for t in text.to_pylist()], bool)
            if model is None:
                lang, score = [UNKNOWN] * part.num_rows, np.zeros(part.num_rows)
            else:
                p = document_probabilities(model, *text_bytes(text))
                best = p.argmax(axis=1)
                lang = [model.langs[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
                score = np.where(known, np.clip(p.max(axis=1), 0, 1), 0.0)
            yield pa.record_batch([*part.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*part.schema.names, "lang_pred", "score"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in table.schema) + "lang_pred string, score double"
    return table.mapInArrow(label, schema)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, with the fold it was held out in.

    Rows without an id count as held out; rows that repeat are judged each for itself. An empty table gives no rows, and
    columns of the input are left out.
    """
    table = documents(spark, sf_dir)
    return predict(table.select("doc_id", "text"), fit(table)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
