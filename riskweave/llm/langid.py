"""Language ID by cross-parsing entropy (Ziv-Merhav).

For each language a suffix automaton of labelled text gives the longest match from any position. A text is
parsed greedily into the longest phrases that occur in a language's text; the fewer phrases a character
needs, the closer the language. The language with the fewest phrases per character wins.

Symbols are the letters and marks of all of Unicode, folded to lower case, and one symbol for runs of anything
else. A letter that no labelled text has can't be in a match, so all such letters share a symbol without
changing any parse. Transitions on the most frequent symbols are a dense table, on the others a sorted list of
edges. An entry also says how many phrases end: one where the character begins the next phrase, two where it
is in no labelled text and so a phrase of its own.

Long texts are parsed in blocks side by side, each first as if a phrase began with it. Then every block is
parsed again from the state in which the one before it really ends, until it falls in with its first parse,
which is mostly after a few phrases; this is repeated until no block's beginning changes. The result is the
parse of the whole text.

Bound: the labelled sample has up to `SAMPLE_DOCS` whole documents a language, chosen by hash of the id among
rows that are not held out, as many of them as fit into `SAMPLE_CHARS` in that order; a language of which none
fits is learned from its shortest one. Everything else covers all rows.

Defined cases: a text that is null, empty or has no letter (emoji, punctuation, digits) is `und` with score 0;
where no row is labelled all are `und`; equal phrase counts go to the first language by code point; rows that
repeat a doc_id are each judged; very long texts are parsed whole, a chunk of bounded size at a time; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, sampled_ids, table, text_chunks, text_slices

#: Documents that a language is learned from at most, and their characters in all.
SAMPLE_DOCS = 40
SAMPLE_CHARS = 40_000
#: Symbols with a column in the dense table.
DENSE = 48
BLOCK = 2048
#: Characters of a text that are parsed at once; longer texts go in chunks.
LONG = 1 << 21
#: Steps into a block at which a second parse is compared with the first one.
MARKS = (32, 64, 128, 256, 512, 1024)
UND = "und"
#: How fast the score falls as languages come closer; it doesn't change who wins.
SHARPNESS = 24.0
#: In the pipeline, a text goes if its best language leads chance by less than this.
LEAST_LEAD = 0.01
_GAP, _UNSEEN = 0, 1
_POINTS = 0x110000


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of each state, symbol -> state; state 0 is the root."""
    link, length = [-1], [0]
    rows: list[dict[int, int]] = [{}]
    last = 0
    for c in text:
        cur = len(rows)
        rows.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in rows[p]:
            rows[p][c] = cur
            p = link[p]
        if p >= 0:
            q = rows[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(rows)
                rows.append(dict(rows[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and rows[p].get(c) == q:
                    rows[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return rows


@dataclass
class Model:
    languages: list[str]
    #: code point -> symbol, and whether it is a letter
    symbol: np.ndarray
    letter: np.ndarray
    #: dense columns
    width: int
    #: all languages' rows, one after another; an entry is (row start << 2) | phrases that end
    table: np.ndarray
    #: where each language's root row starts
    roots: np.ndarray
    #: transitions on symbols beyond the dense ones: sorted (row start << 16 | symbol), and the row start they lead to
    edges: np.ndarray
    targets: np.ndarray
    #: log2 of each sample's length, the cost of a phrase in bits
    phrase_bits: np.ndarray


def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """Which code points are letters, and which are letters or marks."""
    first = np.array([ord(unicodedata.category(chr(c))[0]) for c in range(_POINTS)], np.uint8)
    return first == ord("L"), (first == ord("L")) | (first == ord("M"))


def points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points, one text after another, and each text's length."""
    joined = "".join(texts).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(joined, np.uint32), np.fromiter(map(len, texts), np.int64, len(texts))


def train(samples: dict[str, list[str]], dense: int = DENSE) -> Model:
    letter, kept = _kinds()
    fold = np.arange(_POINTS, dtype=np.uint32)
    for c in np.flatnonzero(letter).tolist():
        low = chr(c).lower()
        if len(low) == 1:
            fold[c] = ord(low)
    texts = {lang: fold[points(["\n".join(samples[lang])])[0]] for lang in sorted(samples)}
    counts: Counter = Counter()
    for cps in texts.values():
        counts.update(dict(zip(*(a.tolist() for a in np.unique(cps[kept[cps]], return_counts=True)))))
    symbol = np.where(kept, _UNSEEN, _GAP).astype(np.uint16)
    # the most frequent ones first; the symbols of a bounded sample are fewer than 2^16
    for k, (c, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))):
        symbol[c] = k + 2
    symbol = symbol[fold]
    width = min(dense, len(counts) + 2)
    none = np.zeros(0, np.int64)
    model = Model(sorted(samples), symbol, letter, width, none.astype(np.int32), none, none, none.astype(np.int32), np.zeros(0))
    parts, roots, bits, edges, targets, at = [], [], [], [], [], 0
    for lang in model.languages:
        seq = symbols(model, texts.pop(lang))
        rows = suffix_automaton(seq.tolist())
        to = np.full((len(rows), width), -1, np.int32)
        for s, row in enumerate(rows):
            for c, t in row.items():
                if c < width:
                    to[s, c] = at + t * width
                else:
                    edges.append(at + s * width << 16 | c)
                    targets.append(at + t * width)
        # without a transition the phrase ends; the next one begins with this symbol, or is this symbol alone
        begins = to[0] >= 0
        restart = np.where(begins, to[0] << 2 | 1, at << 2 | 2)
        entries = np.where(to >= 0, to << 2, restart[None, :])
        entries[0] = np.where(begins, to[0] << 2, at << 2 | 1)
        parts.append(entries.astype(np.int32, copy=False).ravel())
        roots.append(at)
        bits.append(np.log2(max(2, len(seq))))
        at += entries.size
    if parts:
        order = np.argsort(np.array(edges, np.int64))
        model.table, model.roots, model.phrase_bits = np.concatenate(parts), np.array(roots), np.array(bits)
        model.edges, model.targets = np.array(edges, np.int64)[order], np.array(targets, np.int32)[order]
    return model


def symbols(model: Model, cps: np.ndarray) -> np.ndarray:
    """Symbols of a text's code points; a run of gaps counts once."""
    out = model.symbol[cps]
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != _GAP) | (out[:-1] != _GAP)
    return out[keep]


class Parse:
    """The blocks of some texts: symbol sequences that are read by all languages' automata at once."""

    def __init__(self, model: Model, sym: np.ndarray):
        self.model, self.sym = model, sym
        self.rare = bool(len(sym)) and int(sym.max()) >= model.width
        self.dense = np.where(sym < model.width, sym, _UNSEEN) if self.rare else sym

    def step(self, state: np.ndarray, root: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row starts after the symbols at `at`, and the phrases that ended. `at` is the last axis of `state`."""
        got = self.model.table[state + self.dense[at]]
        state_, ended = got >> 2, got & 3
        if self.rare:
            x = self.sym[at].astype(np.int64)
            rare = np.broadcast_to(x >= self.model.width, state.shape)
            if rare.any():
                x, own, begin = np.broadcast_to(x, state.shape)[rare], state[rare].astype(np.int64), np.broadcast_to(root, state.shape)[rare].astype(np.int64)
                next_, fresh = self.edge(own, x), self.edge(begin, x)
                state_[rare] = np.where(next_ >= 0, next_, np.where(fresh >= 0, fresh, begin))
                ended[rare] = np.where(next_ >= 0, 0, np.where(fresh >= 0, 1, 1 + (own != begin)))
        return state_, ended

    def edge(self, state: np.ndarray, x: np.ndarray) -> np.ndarray:
        key = state << 16 | x
        k = np.minimum(np.searchsorted(self.model.edges, key), len(self.model.edges) - 1)
        return np.where(self.model.edges[k] == key, self.model.targets[k], -1)


def phrases(model: Model, texts: list[str], block: int = BLOCK, longest: int = LONG) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phrases (text x language), symbols a text, and whether it has a letter. A text of over `longest` characters is
    parsed in chunks, each from the state in which the one before it ended."""
    langs = len(model.languages)
    count, length, has = np.zeros((len(texts), langs), np.int64), np.zeros(len(texts), np.int64), np.zeros(len(texts), bool)
    root = model.roots.astype(np.int32)[:, None]
    short = [i for i, t in enumerate(texts) if len(t) <= longest]
    if short:
        got = parsed(model, [texts[i] for i in short], block, np.repeat(root, len(short), axis=1), np.zeros(len(short), bool))
        count[short], length[short], has[short] = (got[0] + (got[3] != root)).T, got[1], got[2]
    for i in set(range(len(texts))).difference(short):
        state, gap = root, np.zeros(1, bool)
        for chunk in text_chunks(texts[i], longest):
            more, n, letters, state, gap = parsed(model, [chunk], block, state, gap)
            count[i] += more[:, 0]
            length[i] += n[0]
            has[i] |= letters[0]
        count[i] += (state != root)[:, 0]
    return count, length, has & (length > 0)


def parsed(model: Model, texts: list[str], block: int, begins: np.ndarray, after_gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The phrases that end within each text (language x text), its symbols, whether it has a letter, the states at its
    end, and whether it ends in a gap, from given states (language x text) before it, and whether a gap is before it."""
    cps, sizes = points(texts)
    n = len(texts)
    sym = model.symbol[cps]
    owner = np.repeat(np.arange(n, dtype=np.int32), sizes)
    has = np.bincount(owner, weights=model.letter[cps], minlength=n) > 0
    keep = np.ones(len(sym), bool)
    keep[1:] = (sym[1:] != _GAP) | (sym[:-1] != _GAP) | (owner[1:] != owner[:-1])
    some = np.flatnonzero(sizes)
    first, last = (np.cumsum(sizes) - sizes)[some], np.cumsum(sizes)[some] - 1
    keep[first] &= (sym[first] != _GAP) | ~after_gap[some]
    ends_in_gap = after_gap.copy()
    ends_in_gap[some] = sym[last] == _GAP
    sym, owner = sym[keep], owner[keep]
    length = np.bincount(owner, minlength=n)
    begin = np.concatenate(([0], np.cumsum(length)[:-1]))
    per = -(-length // block)
    text_of = np.repeat(np.arange(n), per)
    k = np.arange(len(text_of)) - np.repeat(np.cumsum(per) - per, per)
    start, size = begin[text_of] + k * block, np.minimum(block, length[text_of] - k * block)
    langs, root = len(model.languages), model.roots.astype(np.int32)
    parse, marks = Parse(model, sym), [m for m in MARKS if m < block]

    # all blocks as if a phrase began with each, the longest first, so that those still running are a prefix
    order = np.argsort(-size, kind="stable")
    state, count = np.repeat(root[:, None], len(size), axis=1), np.zeros((langs, len(size)), np.int64)
    held = np.full((len(marks), langs, len(size)), -1, np.int32)
    after = np.zeros((len(marks), langs, len(size)), np.int64)
    alive = np.searchsorted(-size[order], -np.arange(1, (int(size.max()) if len(size) else 0) + 1), side="right")
    for t, running in enumerate(alive.tolist()):
        own, ended = parse.step(state[:, :running], root[:, None], start[order[:running]] + t)
        state[:, :running] = own
        count[:, :running] += ended
        if t + 1 in marks:
            held[marks.index(t + 1), :, order[:running]] = own.T
            after[marks.index(t + 1), :, order[:running]] = count[:, :running].T
    back = np.argsort(order)
    state, count = state[:, back], count[:, back]
    after = count - after  # phrases from each mark to the block's end

    # again from where the block before really ends, as long as that changes
    came = np.repeat(root[:, None], len(size), axis=1)
    while len(size):
        true = np.where(k > 0, np.roll(state, 1, axis=1), begins[:, text_of])
        lang, at = np.nonzero(came != true)
        if not len(lang):
            break
        came = true
        again(parse, root, start, size, marks, lang, at, came[lang, at], state, count, held, after)
    total, ends = np.zeros((langs, n), np.int64), begins.copy()
    last = np.cumsum(per) - 1
    for j in range(langs):
        total[j] = np.bincount(text_of, weights=count[j], minlength=n)
        ends[j][per > 0] = state[j][last[per > 0]]
    return total, length, has, ends, ends_in_gap


def again(parse: Parse, root: np.ndarray, start: np.ndarray, size: np.ndarray, marks: list[int], lang: np.ndarray, at: np.ndarray, own: np.ndarray, state: np.ndarray, count: np.ndarray, held: np.ndarray, after: np.ndarray) -> None:
    """Parse the blocks `at` of languages `lang` from the states `own`, up to the mark where a block's state is the
    one it had before, or to its end. Changes state, count, held and after of these blocks."""
    ended = np.zeros(len(at), np.int64)
    passed: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
    t = 0

    def close(lang: np.ndarray, at: np.ndarray, total: np.ndarray) -> None:
        """The blocks' counts are known: what lies between each mark passed and the end follows."""
        count[lang, at] = total

    while len(at):
        own, more = parse.step(own, root[lang], start[at] + t)
        ended = ended + more
        t += 1
        done = size[at] == t
        if done.any():
            state[lang[done], at[done]] = own[done]
            close(lang[done], at[done], ended[done])
        met = np.zeros(len(at), bool)
        if t in marks:
            m = marks.index(t)
            met = ~done & (held[m, lang, at] == own)
            close(lang[met], at[met], ended[met] + after[m, lang[met], at[met]])
            left = ~met
            held[m, lang[left], at[left]] = own[left]
            passed.append((m, lang[left], at[left], ended[left]))
        go = ~(done | met)
        lang, at, own, ended = lang[go], at[go], own[go], ended[go]
    for m, lang, at, ended in passed:
        after[m, lang, at] = count[lang, at] - ended


def predict(model: Model, texts: list[str]) -> tuple[list[str], np.ndarray]:
    """The language and score of each text."""
    if not model.languages or not texts:
        return [UND] * len(texts), np.zeros(len(texts))
    count, length, known = phrases(model, texts)
    bits = count * model.phrase_bits / np.maximum(1, length)[:, None]
    best = bits.argmin(axis=1)
    least = np.maximum(bits.min(axis=1, keepdims=True), 1e-9)
    weight = np.exp(-SHARPNESS * (bits - bits.min(axis=1, keepdims=True)) / least / 2)
    score = np.where(known, weight.max(axis=1) / weight.sum(axis=1), 0.0)
    return [model.languages[b] if k else UND for b, k in zip(best, known)], score


def labelled_sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> dict[str, list[str]]:
    """Whole texts by language, none of them held out: of `most` documents chosen by hash of the id, long or short, those
    that fit into `chars` characters in that order; where none does, the language's shortest one."""
    size = F.length(text_col)
    keep = ~held_out(id_col) & F.col(lang_col).isNotNull() & (size > 0)
    ids, _ = sampled_ids(docs, F.col(lang_col), id_col, most, keep, 4)
    picked = sorted({i for own in ids.values() for i in own})
    own_size = docs.where(F.col(id_col).isin(picked) & keep).groupBy(F.col(lang_col).alias("g"), F.col(id_col).alias("i")).agg(F.min(size).alias("n"))
    sizes = {(r.g, r.i): r.n for r in own_size.collect()}
    for g, own in ids.items():
        left, fit = chars, []
        for i in own:
            if sizes[g, i] <= left:
                left -= sizes[g, i]
                fit.append(i)
        ids[g] = fit
    short = [g for g, own in ids.items() if not own]
    if short:
        least = docs.where(keep & F.col(id_col).isNotNull() & F.col(lang_col).isin(short)).groupBy(F.col(lang_col).alias("g")).agg(F.min(F.struct(size.alias("n"), F.col(id_col).alias("i"))).alias("m"))
        ids |= {r.g: [r.m.i] for r in least.collect()}  # one row a language
    if not ids:
        return {}
    rows = docs.where(F.col(id_col).isin(sorted({i for own in ids.values() for i in own})) & keep)
    rows = rows.select(F.col(id_col).alias("i"), F.col(lang_col).alias("g"), F.col(text_col).alias("t"), size.alias("n"))
    rows = rows.groupBy("g", "i").agg(F.min(F.struct("n", "t")).alias("m"))  # ids that repeat count once
    found: dict[str, list[str]] = {}
    for r in sorted(rows.select("g", "i", "m.t").collect(), key=lambda r: (r.g, r.i)):
        if r.i in set(ids[r.g]):
            found.setdefault(r.g, []).append(r.t)
    return found


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(train(labelled_sample(docs, id_col, text_col, lang_col)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                lang, score = predict(shared.value, [t or "" for t in part.column(2).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op4_langid(spark, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def stage_langid(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without letters (null and empty texts among them), and those no language
    stands out for, go. Rows that repeat are each judged; all columns stay as they are."""
    shared = spark.sparkContext.broadcast(train(labelled_sample(docs)))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                lang, score = predict(shared.value, [t or "" for t in part.column(at).to_pylist()])
                least = 1 / max(1, len(shared.value.languages)) + LEAST_LEAD
                keep = [name != UND and (s >= least or least > 1) for name, s in zip(lang, score)]
                yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
