"""Toxicity by a classifier chain.

Categories are predicted one after another by logistic models over the words of a document; each later model also
gets the earlier categories' probabilities. In training those are out-of-fold: for every fold the category's words
are chosen and its model is fitted on the other folds only, so later models learn from probabilities as good as the
ones they will meet. Every category has a vocabulary of its own: words and beginnings of words (`stem*`) that tell
its labels apart, and terms among them, which occur in enough documents of the category and almost only there.

`CATEGORIES` names a chain: (category, column of the labels table, values that count as it). The labels table
annotates `quality` and `toxic` and no kinds of toxicity, so the chain is `junk`, then `toxic`; a table with more
label columns takes a longer chain through `categories`.

Near copies share their weight in training (rows whose two least hashes of five-word shingles agree), so one text
copied many times makes none of its words a term; no row is left out. They share a fold too: an out-of-fold
probability comes from a model that has seen no copy of the text.

Bounds: up to `SAMPLE_TOXIC` toxic and `SAMPLE_OTHER` other whole documents, of `SAMPLE_BYTES` in all, chosen by hash of
the id among rows that are not held out. The classes' shares among all labelled rows correct the last intercept. Whole texts are
scored, long ones piece by piece.

Defined cases: a null text is empty; a text without any feature gets the models' intercepts; where fewer than two
classes of `toxic` are labelled all probabilities are the share of toxic labels (0 without labels); a category
without two classes in the sample has its share as probability; rows that repeat a doc_id are each scored; ids
labelled twice count once, with the least label; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, sampled_ids, sampled_texts, table, text_chunks, text_slices

#: (category, label column, values that count as it); the last one is the verdict.
CATEGORIES = (("junk", "quality", (0,)), ("toxic", "toxic", (1,)))
SAMPLE_TOXIC = 1024
SAMPLE_OTHER = 3072
#: Bytes of text that training takes to the driver.
SAMPLE_BYTES = 64 << 20
#: Words a category's linear model sees, and what share of a term's documents must be of the category.
VOCABULARY = 256
PURE = 0.9
#: How sure a term must be: its log odds ratio over its error.
SURE = 2.5
#: In how many documents of the category a word must be, copies counted once.
LEAST = 3
#: Lengths of the word beginnings that count besides whole words.
STEMS = range(4, 9)
#: Words whose features a worker remembers, and how long these are at most.
REMEMBERED, REMEMBERED_LENGTH = 200_000, 40
FOLDS = 5
RIDGE = 1.0
THRESHOLD = 0.5
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Link:
    """One category of the chain."""

    name: str
    #: its vocabulary and its terms
    words: list[str]
    terms: frozenset[str]
    #: intercept, words, term hits, hits in a hundred words, earlier probabilities
    weights: np.ndarray


@dataclass
class Model:
    links: list[Link] = field(default_factory=list)
    names: tuple[str, ...] = tuple(c[0] for c in CATEGORIES)
    prior: float | None = None
    #: key -> columns, for all links' vocabularies side by side; hits of a link's terms have a column too
    columns: dict[str, tuple[int, ...]] = field(default_factory=dict)
    term_columns: dict[str, tuple[int, ...]] = field(default_factory=dict)
    width: int = 0
    #: what of_word() gave for words seen before
    known: dict[str, tuple[int, ...]] = field(default_factory=dict)


def tokens(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def word_counts(text: str) -> Counter:
    out: Counter = Counter()
    for part in text_chunks(text):
        out.update(tokens(part))
    return out


def keys(word: str) -> list[str]:
    """The word and its beginnings."""
    return [word, *(word[:k] + "*" for k in STEMS if k < len(word))]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = RIDGE, rounds: int = 25) -> np.ndarray:
    """Ridge logistic regression by Newton's method; the intercept isn't penalised."""
    x = np.concatenate((np.ones((len(x), 1)), x), axis=1)
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[0] = 1e-3
    for _ in range(rounds):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (weight * (y - p)) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-4:
            break
    return w


def probability(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return sigmoid(w[0] + x @ w[1:])


def copies_key(words: list[str], width: int = 5) -> tuple[int, int]:
    """Two least hashes of a text's shingles: near copies mostly share them, other texts don't."""
    h = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    mixed = np.zeros(n, np.uint64)
    for k in range(min(width, len(h))):
        mixed = mixed * np.uint64(0x100000001B3) + h[k : k + n] + np.uint64(1)
    return int((mixed * np.uint64(0x9E3779B97F4A7C15)).min()), int((mixed * np.uint64(0xC2B2AE3D27D4EB4F)).min())


class Sample:
    """The training texts as rows of (key, count); keys are numbered. Only keys of three `marked` texts or more (all
    texts, if none are named) get a number: no other can be chosen, and most words are rare."""

    def __init__(self, texts: list[str], marked: list[bool] | None = None):
        seen: Counter = Counter()
        for text, on in zip(texts, marked or [True] * len(texts)):
            if on:
                seen.update({k for w in set(tokens(text)) for k in keys(w) if len(k) > 2})
        number = {k: i for i, k in enumerate(k for k, n in seen.items() if n >= LEAST)}
        of_word: dict[str, tuple[int, ...]] = {}
        del seen
        rows, cols, counts, length, copies = [], [], [], [], []
        for i, text in enumerate(texts):
            words = tokens(text)
            own: Counter = Counter()
            for w, n in Counter(words).items():
                ids = of_word.get(w)
                if ids is None:
                    ids = of_word[w] = tuple(number[k] for k in keys(w) if k in number)
                for k in ids:
                    own[k] += n
            cols.append(np.fromiter(own.keys(), np.int32, len(own)))
            counts.append(np.fromiter(own.values(), np.int32, len(own)))
            rows.append(np.full(len(own), i, np.int32))
            length.append(len(words))
            copies.append(copies_key(words))
        self.n, self.keys = len(texts), list(number)
        self.rows, self.cols, self.counts = np.concatenate(rows), np.concatenate(cols), np.concatenate(counts)
        self.length = np.array(length)
        group = Counter(copies)
        self.weight = np.array([1 / group[c] for c in copies])
        number = {c: k for k, c in enumerate(dict.fromkeys(copies))}
        self.fold = np.array([number[c] for c in copies]) % FOLDS

    def choose(self, use: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(vocabulary, terms) as key numbers, from the rows in `use` alone."""
        w1, w0 = self.weight * (use & (y == 1)), self.weight * (use & (y == 0))
        with_ = np.bincount(self.cols, w1[self.rows], len(self.keys))
        without = np.bincount(self.cols, w0[self.rows], len(self.keys))
        n1, n0 = w1.sum(), w0.sum()
        fine = with_ >= max(LEAST, 0.01 * n1)
        odds = np.log((with_ + 0.5) / (n1 - with_ + 0.5)) - np.log((without + 0.5) / (n0 - without + 0.5))
        odds /= np.sqrt(1 / (with_ + 0.5) + 1 / (without + 0.5))
        sure = np.flatnonzero(fine & (np.abs(odds) >= SURE))
        terms = sure[(odds[sure] > 0) & (with_[sure] / n1 >= PURE * (with_[sure] / n1 + without[sure] / n0))]
        chosen = sorted(sure.tolist(), key=lambda k: (-abs(odds[k]), self.keys[k]))[:VOCABULARY]
        return np.array(chosen, np.int64), terms

    def features(self, chosen: np.ndarray, terms: np.ndarray) -> np.ndarray:
        place = np.full(len(self.keys), -1)
        place[chosen] = np.arange(len(chosen))
        out = np.zeros((self.n, len(chosen) + 2))
        on = place[self.cols] >= 0
        out[self.rows[on], place[self.cols[on]]] = self.counts[on]
        term = np.zeros(len(self.keys), bool)
        term[terms] = True
        on = term[self.cols]
        # a word counts once for each of its keys that is a term, here as in of_word()
        out[:, -2] = np.bincount(self.rows[on], self.counts[on], self.n)
        return finished(out, self.length)


def finished(x: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Counts to log(1 + count), and the last column from the one before: hits in a hundred words."""
    x[:, -1] = 100 * x[:, -2] / np.maximum(1, length)
    x[:, :-1] = np.log1p(x[:, :-1])
    return x


def train(texts: list[str], targets: dict[str, list[int | None]], counts: dict[int, int] | None = None) -> Model:
    """`targets`: a label (1, 0 or None) of every text for each category, in the chain's order. `texts` are in a
    fixed order; folds are dealt in turn to groups of near copies. `counts`: labelled rows by class of the last category in the whole table."""
    names = tuple(targets)
    ys = {c: np.array([np.nan if v is None else float(v) for v in t]) for c, t in targets.items()}
    last = ys[names[-1]]
    if len(set(last[~np.isnan(last)])) < 2:
        known = last[~np.isnan(last)]
        return Model(names=names, prior=float(known.mean()) if len(known) else 0.0)
    sample = Sample(texts, [any(t[k] for t in targets.values()) for k in range(len(texts))])
    model, earlier, fold = Model(names=names), np.zeros((sample.n, 0)), sample.fold
    for name in names:
        y = ys[name]
        has = ~np.isnan(y)

        def fit(use: np.ndarray, y: np.ndarray = y, earlier: np.ndarray = earlier) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            if len(set(y[use])) < 2:
                share = (y[use].sum() + 0.5) / (use.sum() + 1)
                none = np.zeros(0, np.int64)
                x = np.concatenate((sample.features(none, none), earlier), axis=1)
                return none, none, np.concatenate(([np.log(share / (1 - share))], np.zeros(x.shape[1]))), x
            chosen, terms = sample.choose(use, y)
            x = np.concatenate((sample.features(chosen, terms), earlier), axis=1)
            return chosen, terms, logistic(x[use], y[use], sample.weight[use]), x

        chosen, terms, weights, _ = fit(has)
        if name == names[-1] and counts:
            own = sample.weight * has
            weights[0] += np.log(counts[1] / counts[0]) - np.log((own * (last == 1)).sum() / (own * (last == 0)).sum())
        model.links.append(Link(name, [sample.keys[k] for k in chosen], frozenset(sample.keys[k] for k in terms), weights))
        if name != names[-1]:
            out_of_fold = np.zeros(sample.n)
            for k in range(FOLDS):
                _, _, w, x = fit(has & (fold != k))
                out_of_fold[fold == k] = probability(w, x[fold == k])
            earlier = np.concatenate((earlier, out_of_fold[:, None]), axis=1)
    return indexed(model)


def indexed(model: Model) -> Model:
    """Number the columns of all links: each has its words, term hits, and hits in a hundred words."""
    at = 0
    for link in model.links:
        for k, w in enumerate(link.words):
            model.columns[w] = (*model.columns.get(w, ()), at + k)
        for w in link.terms:
            model.term_columns[w] = (*model.term_columns.get(w, ()), at + len(link.words))
        at += len(link.words) + 2
    model.width = at
    return model


def of_word(model: Model, word: str) -> tuple[int, ...]:
    """The columns that a word counts in."""
    columns = []
    for k in keys(word):
        columns += model.columns.get(k, ())
        columns += model.term_columns.get(k, ())
    return tuple(columns)


def probabilities(model: Model, texts: list[str]) -> np.ndarray:
    """One row a text, one column a category, along the chain."""
    if model.prior is not None or not texts:
        return np.full((len(texts), len(model.names)), model.prior or 0.0)
    x, length, known = np.zeros((len(texts), model.width)), np.zeros(len(texts)), model.known
    for k, text in enumerate(texts):
        found = word_counts(text)
        length[k] = found.total()
        if len(known) > REMEMBERED:
            known.clear()
        row = x[k]
        for word, n in found.items():
            got = known.get(word)
            if got is None:
                got = of_word(model, word)
                if len(word) <= REMEMBERED_LENGTH:
                    known[word] = got
            for c in got:
                row[c] += n
    out, at = np.zeros((len(texts), 0)), 0
    for link in model.links:
        own = finished(x[:, at : at + len(link.words) + 2], length)
        p = probability(link.weights, np.concatenate((own, out), axis=1))
        out = np.concatenate((out, p[:, None]), axis=1)
        at += own.shape[1]
    return out


def fitted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", categories: tuple = CATEGORIES) -> Model:
    """The chain, trained on a bounded sample of labelled rows."""
    of = lambda column, values: F.when(F.col(column).isNotNull(), F.col(column).isin(list(values)).cast("int"))
    marks = [F.min(of(column, values)).alias(name) for name, column, values in categories]
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*marks)
    names = [c[0] for c in categories]
    ids, counts = sampled_ids(known, F.col(names[-1]), "doc_id", {1: SAMPLE_TOXIC, 0: SAMPLE_OTHER}, ~held_out("doc_id"), 7)
    picked = [i for own in ids.values() for i in own]
    if not picked:
        return Model(names=tuple(names), prior=0.0)
    marked = {r.doc_id: r for r in known.where(F.col("doc_id").isin(picked)).collect()}
    sample = sorted(sampled_texts(docs, ids, id_col, text_col, SAMPLE_BYTES).items())
    return train([t for _, t in sample], {c: [marked[i][c] for i, _ in sample] for c in names}, counts)


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, categories: tuple = CATEGORIES) -> DataFrame:
    """doc_id, held_out, a probability for each category, score (the last one's) and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, id_col, text_col, categories))
    names = ["doc_id", "held_out", *(f"p_{c[0]}" for c in categories), "score", "predicted"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                p = probabilities(shared.value, [t or "" for t in part.column(2).to_pylist()])
                cols = [*(pa.array(c) for c in p.T), pa.array(p[:, -1]), pa.array((p[:, -1] >= threshold).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *cols], names)

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    doubles = ", ".join(f"{n} double" for n in names[2:-1])
    return narrow.mapInArrow(run, f"doc_id long, held_out boolean, {doubles}, predicted int")


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def stage_toxicity(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents predicted toxic go. The model learns from all documents that have labels and are
    still there. Null and empty texts stay unless the intercept alone says toxic; rows that repeat are each judged;
    all columns stay as they are."""
    shared = spark.sparkContext.broadcast(fitted(docs, table(spark, sf_dir, "labels")))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                p = probabilities(shared.value, [t or "" for t in part.column(at).to_pylist()])
                yield part.filter(pa.array(p[:, -1] < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
