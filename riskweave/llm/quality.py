"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of `PASSAGE_WORDS` words. A passage is encoded by one tanh layer over the mean of
its words' learned vectors (words are hashed to `BUCKETS` vectors) and over shape features (character classes,
word lengths, repetition). Gated attention, softmax of w . (tanh(V h) * sigmoid(U h)), weighs the passages; the
weighted sum of encodings is scored by a logistic unit. Only documents have labels; the attention learns which
passages carry them. Trained here by gradient descent, end to end.

Bound: up to `SAMPLE_DOCS` labelled documents a class, of `SAMPLE_BYTES` in all, chosen by hash of the id among rows that are not held out;
training sees all passages of their whole texts. The classes' shares among all labelled rows correct the
intercept, so that scores mean the same where the bound bites and where it doesn't.

Defined cases: a text that is null, empty or without words is one passage whose features are all zero; a very long
text is encoded piece by piece, cut between passages, with the attention's sums carried along; where fewer than two
classes are labelled every score is the share of label 1 (0.5 without labels); rows that repeat a doc_id are each
scored; ids labelled twice count once, with the least label; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, sampled_ids, sampled_texts, table, text_slices

PASSAGE_WORDS = 64
SAMPLE_DOCS = 1024
#: Bytes of text that training takes to the driver.
SAMPLE_BYTES = 64 << 20
HIDDEN = 16
BUCKETS = 4096
EPOCHS = 40
THRESHOLD = 0.7
#: Bytes of a long text that are encoded at once.
PIECE = 1 << 20

# Classes of UTF-8 bytes.
_SPACE, _LINE, _LOWER, _UPPER, _DIGIT, _STOP, _QUOTE, _BAR, _SYMBOL, _HIGH, _CONTROL = range(11)
_CLASSES = 11


def _byte_classes() -> np.ndarray:
    out = np.full(256, _SYMBOL, np.uint8)
    out[:32] = _CONTROL
    out[127] = _CONTROL
    out[128:] = _HIGH
    out[[9, 11, 12, 32]] = _SPACE
    out[[10, 13]] = _LINE
    out[97:123] = _LOWER
    out[65:91] = _UPPER
    out[48:58] = _DIGIT
    out[[ord(c) for c in ".,;:!?"]] = _STOP
    out[[ord(c) for c in "'\"()-"]] = _QUOTE
    out[ord("|")] = _BAR
    return out


_CLASS = _byte_classes()
_MIX = np.random.default_rng(6).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[65:91] += 32
FEATURES = _CLASSES + 11


@dataclass
class Bags:
    #: shape features of every passage
    shape: np.ndarray
    #: the bucket of every word, and how many words a passage has
    bucket: np.ndarray
    words: np.ndarray
    #: passages of every text, one at least
    count: np.ndarray


def passages(texts: list[str | bytes], words: int = PASSAGE_WORDS, buckets: int = BUCKETS) -> Bags:
    """The passages of some texts, in order."""
    n = len(texts)
    raws = [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else t for t in texts]
    sizes = np.fromiter(map(len, raws), np.int64, n)
    data = np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)
    begins = np.concatenate(([0], np.cumsum(sizes + 1)))
    cls = _CLASS[data]
    blank = (cls == _SPACE) | (cls == _LINE)
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank)).astype(np.int8)))
    starts, stops = edge[0::2], edge[1::2]
    doc = np.searchsorted(begins, starts, side="right") - 1
    per_doc = np.bincount(doc, minlength=n)
    nth = np.arange(len(starts)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
    count = np.maximum(1, -(-per_doc // words))
    first = np.cumsum(count) - count
    passage = first[doc] + nth // words
    total = int(count.sum())
    out = np.zeros((total, FEATURES), np.float32)
    if not len(starts):
        return Bags(out, np.zeros(0, np.int64), np.zeros(total, np.int64), count)
    # bytes belong to the passage of the last word that began before them, or the document's first; what
    # separates documents, and documents without words, count nowhere
    head = np.flatnonzero(np.concatenate(([True], passage[1:] != passage[:-1])))
    ids = passage[head]
    at = np.where(nth[head] == 0, begins[doc[head]], starts[head])
    tops = np.concatenate((at[1:], [len(data)]))
    kind = cls.copy()
    kind[begins[1:] - 1] = _CLASSES
    kind[np.repeat(per_doc == 0, sizes + 1)] = _CLASSES
    owner = np.repeat(ids, tops - at)
    hist = np.bincount(owner * (_CLASSES + 1) + kind[at[0] :], minlength=total * (_CLASSES + 1)).reshape(total, -1)[:, :_CLASSES]
    size = np.maximum(1, hist.sum(axis=1))
    out[:, :_CLASSES] = hist / size[:, None]
    length = stops - starts
    low = starts[0]
    inside = np.arange(len(data))[low:] - np.repeat(starts, np.diff(np.concatenate((starts, [len(data)]))))
    mixed = _FOLD[data[low:]] * _MIX[np.minimum(inside, 63)]
    mixed[blank[low:]] = 0
    word = np.add.reduceat(mixed, starts - low)
    in_passage = np.maximum(1, np.bincount(passage, minlength=total))
    mean = lambda x: np.bincount(passage, weights=x, minlength=total) / in_passage
    same = np.zeros(len(word), bool)
    same[1:] = (word[1:] == word[:-1]) & (passage[1:] == passage[:-1])
    key = np.lexsort((word, passage))
    fresh = np.ones(len(word), bool)
    fresh[1:] = (word[key][1:] != word[key][:-1]) | (passage[key][1:] != passage[key][:-1])
    distinct = np.bincount(passage[key], weights=fresh, minlength=total) / in_passage
    lead, tail = cls[starts], cls[stops - 1]
    alpha = (lead == _LOWER) | (lead == _UPPER) | (lead == _HIGH)
    extra = (
        mean(length) / 10,
        np.sqrt(np.maximum(0, mean(length.astype(float) ** 2) - mean(length) ** 2)) / 10,
        mean(length <= 3),
        mean(length > 14),
        mean(lead == _UPPER),
        mean(tail == _STOP),
        mean(~alpha),
        mean((length == 1) & ~alpha),
        mean((tail == _SYMBOL) | (tail == _BAR)),
        mean(same),
        distinct,
    )
    for k, x in enumerate(extra):
        out[:, _CLASSES + k] = x
    bucket = (word * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % buckets
    return Bags(out, bucket, np.bincount(passage, minlength=total), count)


def long_pieces(raw: bytes, size: int = PIECE, words: int = PASSAGE_WORDS) -> Iterator[bytes]:
    """A text's bytes in pieces of whole passages, of about `size` bytes (or one passage, if that is longer)."""
    at, take = 0, size
    while at + take < len(raw):
        kind = _CLASS[np.frombuffer(raw, np.uint8, take, at)]
        blank = (kind == _SPACE) | (kind == _LINE)
        starts = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))
        whole = (len(starts) - 1) // words * words
        if whole <= 0:
            take *= 2
            continue
        yield raw[at : at + int(starts[whole])]
        at, take = at + int(starts[whole]), size
    yield raw[at:]


@dataclass
class Model:
    shift: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]
    prior: float | None = None


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def encode(p: dict[str, np.ndarray], shape: np.ndarray, bags: Bags) -> np.ndarray:
    """Encodings of passages from standardised shape features and the mean of their words' vectors."""
    mean = np.zeros((len(shape), p["E"].shape[1]), p["E"].dtype)
    some = bags.words > 0
    if some.any():
        mean[some] = np.add.reduceat(p["E"][bags.bucket], _starts(bags.words)[some], axis=0) / bags.words[some][:, None]
    return np.tanh(shape @ p["W"] + p["b"] + mean)


def attend(p: dict[str, np.ndarray], h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The gates and the attention score of each passage."""
    t, s = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
    return t, s, (t * s) @ p["w"]


def gradients(p: dict[str, np.ndarray], shape: np.ndarray, bags: Bags, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """The mean cross-entropy of some documents and its gradient in every parameter."""
    first, of = _starts(bags.count), np.repeat(np.arange(len(y)), bags.count)
    h = encode(p, shape, bags)
    t, s, e = attend(p, h)
    a = np.exp(e - np.maximum.reduceat(e, first)[of])
    a /= np.add.reduceat(a, first)[of]
    z = np.add.reduceat(a[:, None] * h, first, axis=0)
    out = _sigmoid(z @ p["c"] + p["d"])
    loss = -float(np.mean(y * np.log(out + 1e-12) + (1 - y) * np.log(1 - out + 1e-12)))
    dy = (out - y) / len(y)
    g = {"c": z.T @ dy, "d": dy.sum()}
    dz = dy[:, None] * p["c"]
    da = (dz[of] * h).sum(axis=1)
    de = a * (da - np.add.reduceat(a * da, first)[of])
    g["w"] = (t * s).T @ de
    dts = de[:, None] * p["w"]
    dt, ds = dts * s * (1 - t**2), dts * t * s * (1 - s)
    g["V"], g["U"] = h.T @ dt, h.T @ ds
    dh = (a[:, None] * dz[of] + dt @ p["V"].T + ds @ p["U"].T) * (1 - h**2)
    g["W"], g["b"] = shape.T @ dh, dh.sum(axis=0)
    g["E"] = np.zeros_like(p["E"])
    if len(bags.bucket):
        order = np.argsort(bags.bucket, kind="stable")
        sorted_ = bags.bucket[order]
        head = np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1])))
        each = np.repeat(np.arange(len(shape)), bags.words)[order]
        g["E"][sorted_[head]] = np.add.reduceat((dh / np.maximum(1, bags.words)[:, None])[each], head, axis=0)
    return loss, g


def start(hidden: int, buckets: int, seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    p = {k: rng.normal(0, 0.3, shape) for k, shape in (("W", (FEATURES, hidden)), ("b", hidden), ("V", (hidden, hidden)), ("U", (hidden, hidden)), ("w", hidden), ("c", hidden))}
    return p | {"d": np.zeros(()), "E": np.zeros((buckets, hidden))}


def train(texts: list[str], labels: list[int], counts: dict[int, int] | None = None, hidden: int = HIDDEN, epochs: int = EPOCHS, seed: int = 6) -> Model:
    """`counts`: labelled rows by class in the whole table, to correct the intercept for the sample's shares."""
    flat = np.zeros(FEATURES, np.float32)
    y = np.array(labels, np.float64)
    if len(set(labels)) < 2:
        return Model(flat, flat + 1, {}, float(y.mean()) if len(y) else 0.5)
    size = 64
    # batches are dealt once, of documents of like length; each epoch takes them in another order
    rng = np.random.default_rng(seed)
    by_length = sorted(rng.permutation(len(texts)).tolist(), key=lambda i: len(texts[i]) // 2000)
    groups = [by_length[k::max(1, len(texts) // size)] for k in range(max(1, len(texts) // size))]
    batches = [(passages([texts[i] for i in rows]), y[rows]) for rows in groups]
    every = np.concatenate([b.shape for b, _ in batches])
    shift, scale = every.mean(axis=0), every.std(axis=0) + 1e-3
    batches = [((b.shape - shift) / scale, b, own) for b, own in batches]
    p = start(hidden, BUCKETS, seed)
    m, v, step = {k: np.zeros_like(q) for k, q in p.items()}, {k: np.zeros_like(q) for k, q in p.items()}, 0
    for _ in range(epochs):
        for k in rng.permutation(len(batches)).tolist():
            shape, bags, own = batches[k]
            g = gradients(p, shape, bags, own)[1]
            step += 1
            for k_ in p:
                # words' vectors are many and seen seldom: they learn slower and decay faster
                rate, decay = (0.003, 1e-3) if k_ == "E" else (0.01, 1e-4)
                grad = g[k_] + decay * p[k_]
                m[k_] = 0.9 * m[k_] + 0.1 * grad
                v[k_] = 0.999 * v[k_] + 0.001 * grad**2
                p[k_] = p[k_] - rate * (m[k_] / (1 - 0.9**step)) / (np.sqrt(v[k_] / (1 - 0.999**step)) + 1e-6)
    if counts:
        p["d"] = p["d"] + np.log(counts[1] / counts[0]) - np.log(y.sum() / (len(y) - y.sum()))
    return Model(shift, scale, {k: q.astype(np.float32) for k, q in p.items()})


def pooled(model: Model, texts: list[str | bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text the highest attention score, and the sums of exp(score - highest) and of it times the encoding."""
    bags, p = passages(texts), model.weights
    h = encode(p, (bags.shape - model.shift) / model.scale, bags)
    e = attend(p, h)[2]
    first = _starts(bags.count)
    top = np.maximum.reduceat(e, first)
    a = np.exp(e - np.repeat(top, bags.count))
    return top, np.add.reduceat(a, first), np.add.reduceat(a[:, None] * h, first, axis=0)


def score(model: Model, texts: list[str], piece: int = PIECE) -> np.ndarray:
    """The probability of label 1 of each text, over all its passages."""
    if not texts:
        return np.zeros(0)
    if model.prior is not None:
        return np.full(len(texts), model.prior)
    raws = [t.encode("utf-8", "surrogatepass") for t in texts]
    weight, total = np.zeros(len(raws)), np.zeros((len(raws), model.weights["E"].shape[1]))
    short = [k for k, r in enumerate(raws) if len(r) <= piece]
    if short:
        _, weight[short], total[short] = pooled(model, [raws[k] for k in short])
    for k in set(range(len(raws))).difference(short):
        top = -np.inf
        for part in long_pieces(raws[k], piece):
            t, w, z = (x[0] for x in pooled(model, [part]))
            both = max(top, t)
            weight[k] = weight[k] * np.exp(top - both) + w * np.exp(t - both)
            total[k] = total[k] * np.exp(top - both) + z * np.exp(t - both)
            top = both
    z = total / weight[:, None]
    return _sigmoid(z @ model.weights["c"] + model.weights["d"]).astype(np.float64)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int | dict[int, int], id_col: str = "doc_id", text_col: str = "text") -> tuple[list[tuple[int, str, int]], dict[int, int]]:
    """((id, whole text, label) of up to `most` documents for each value of `label`, none of them held out, of
    `SAMPLE_BYTES` in all; how many rows have each value). Ids are picked from the narrow labels table, so the texts are
    read once, for those."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min((F.col(label) > 0).cast("int")).alias("y"))
    ids, counts = sampled_ids(known, F.col("y"), "doc_id", most, ~held_out("doc_id"), 6)
    of = {i: y for y, own in ids.items() for i in own}
    return sorted((i, t, of[i]) for i, t in sampled_texts(docs, ids, id_col, text_col, SAMPLE_BYTES).items()), counts


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    sample, counts = labelled_sample(docs, labels, "quality", SAMPLE_DOCS, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(train([t for _, t, _ in sample], [y for _, _, y in sample], counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text", PIECE):
                s = score(shared.value, [t or "" for t in part.column(2).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"]
                )

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op6_quality(spark, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
