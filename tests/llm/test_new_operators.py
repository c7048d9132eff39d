"""Spelling variants, decontamination and the prefix trie against plain versions, and their defined cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from riskweave.llm import decontaminate, prefixtrie, variants

DOCS = "doc_id long, text string, word string, n long, block string, spans string, items string"
ITEMS = "item_id string, text string, n long"
TURNS = "conv_id long, turn long, role string, text string, node long, depth long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "w", 0, "b", "s", "i") for i, t in rows], DOCS)


# ---- spelling variants


def plain_counts(rows):
    out = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def plain_near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(counts):
    out = {}
    for w, n in counts.items():
        near = [v for v in counts if plain_near(w, v)]
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        form = best if best is not None and counts[best] >= 2 * n else None
        out[w] = (form, n, len(near), counts[form] if form else None)

    def root(w):
        return w if out[w][0] is None else root(out[w][0])

    return {(w, f, root(w), n, k, m) for w, (f, n, k, m) in out.items()}


def found_variants(docs, **more):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in variants.spelling_variants(docs, **more).collect()}


@pytest.mark.parametrize("split", [3, 2048])
def test_variants_are_those_of_all_pairs(spark, split):
    """Few letters make crowded blocks; a small `split` divides them between tasks too."""
    draw = random.Random(5)
    words = ["".join(draw.choice("abÀé") for _ in range(draw.randint(5, 8))) for _ in range(400)]
    words += ["x" * 90 + "abc", "x" * 90 + "abd", "x" * 91 + "abc", "TAAAB", "ab×cd÷"]
    rows = [(k, " ".join(draw.choice(words) + draw.choice(" .1") for _ in range(60))) for k in range(120)] + [(1, " ".join(words[-5:] * 4))]
    want = plain_variants(plain_counts(rows))
    assert any(w[1] for w in want) and max(w[4] for w in want) >= 8
    assert found_variants(docs_of(spark, rows), split=split) == want


def test_variants_of_odd_rows(spark):
    assert found_variants(docs_of(spark, [])) == set()
    long = "Mutable mutable mutible mutible mutible mutable mutable mutable mutable mutable " * 40_000
    rows = [(None, None), (None, "apple apple apple"), (3, ""), (3, "apple, APPLE apple_apple"), (3, "apple, APPLE apple_apple"), (4, "appleé ÀPPLE àpple"), (5, long)]
    assert found_variants(docs_of(spark, rows)) == plain_variants(plain_counts(rows))


def test_mutation_by_document():
    changed = [i for i in range(3000) if variants.counted(str(i), "Example") != Counter({"example": 1})]
    assert changed and all(zlib.crc32(f"{i}:example".encode()) % 97 == 0 for i in changed)
    assert all(variants.counted(str(i), "Example example") == Counter({next(iter(variants.counted(str(i), "Example"))): 2}) for i in changed)


@pytest.mark.parametrize("alphabet", ["ab", "abcdefghijklmnopqrstuvwxyz"])
def test_each_pair_is_linked_once(alphabet):
    draw = random.Random(len(alphabet))
    for _ in range(60):
        short = draw.randint(5, 9)
        stem = "".join(draw.choice(alphabet) for _ in range(short))
        block = {stem}
        for _ in range(60):
            at = draw.randrange(short)
            block.add(draw.choice([stem[:at] + draw.choice(alphabet) + stem[at + 1 :], stem[:at] + draw.choice(alphabet) + stem[at:], draw.choice(sorted(w for w in block if len(w) == short)).replace("a", "b", 1)]))
        links = Counter()
        variants.scan([(w, 1) for w in sorted(block)], short, 0, 0, 1 << 30, lambda a, b: links.update([frozenset((a[0], b[0]))]))
        want = {frozenset((a, b)) for a in block for b in block if len(a) == short and plain_near(a, b)}
        assert links == Counter(dict.fromkeys(want, 1))


# ---- decontamination

PLAIN_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return PLAIN_WORD.findall((text or "").translate(LOWER))


def plain_search(text, items, window=10):
    words, hit, found = plain_words(text), set(), set()
    for item_id, item in items:
        own = plain_words(item)
        m = min(window, len(own))
        for s in range(len(own) - m + 1 if m else 0):
            for at in range(len(words) - m + 1):
                if words[at : at + m] == own[s : s + m]:
                    hit.update(range(at, at + m))
                    found.add(item_id or "")
    return len(words), len(hit), sorted(found)


def benchmark(draw, vocabulary):
    items = [(str(k), " ".join(draw.choice(vocabulary) for _ in range(n))) for k, n in enumerate([0, 1, 2, 3, 9, 10, 11, 14, 30])]
    return items + [("8", items[7][1]), ("x", None), (None, items[6][1].upper()), ("y", "Same-" * 12)]


@pytest.mark.parametrize("shard_bytes", [1 << 24, 60])
def test_windows_are_those_of_a_plain_search(spark, shard_bytes):
    draw = random.Random(3)
    vocabulary = ["a", "the", "Éa", "日本", "x1", "word", "Same"]
    items = benchmark(draw, vocabulary)
    rows = [(None, None), (1, ""), (2, "-- ??"), (3, "the"), (3, "the")]
    for k in range(60):
        words = [draw.choice(vocabulary) for _ in range(draw.randint(0, 80))]
        if k % 2:
            words[draw.randint(0, len(words)) :] = (draw.choice(items)[1] or "").split()
        rows.append((k, draw.choice([" ", "\n", "-_ "]).join(words)))
    rows += [(99, "the rest of it " * 5 + items[8][1].swapcase().replace("É", "É"))] * 3
    docs, bench = docs_of(spark, rows), spark.createDataFrame([(i, t, 1) for i, t in items], ITEMS)
    found = decontaminate.find_windows(docs, bench, shard_bytes=shard_bytes)
    got = sorted((r.doc_id or -1, r.n_words, r.n_hit, r["items"]) for r in found.collect())
    assert got == sorted((i or -1, *plain_search(t, items)) for i, t in rows)
    assert any(g[2] for g in got) and any(not g[2] for g in got)
    for r in found.collect():
        assert r.n_hit == sum(s.stop - s.start for s in r.spans) and all(a.stop < b.start for a, b in zip(r.spans, r.spans[1:]))


def test_search_skips_and_whole_texts(spark):
    draw = random.Random(9)
    vocabulary = [f"w{k}" for k in range(300)]
    item = " ".join(draw.choice(vocabulary) for _ in range(40))
    text = " ".join(draw.choice(vocabulary) for _ in range(500_000)) + " " + item  # over the size of a piece
    tables = decontaminate.Tables.build([("i", item)])
    n, hit, spans, items = decontaminate.search(tables, [text.encode()])[0]
    assert (n, hit, list(map(tuple, spans)), items) == (500_040, 40, [(500_000, 500_040)], ["i"])
    assert (tables.patterns[0].shift > 0).mean() > 0.5
    assert [len(x) for x in decontaminate.words_of(b"x" * 3_000_000)] == [1]
    empty = spark.createDataFrame([], ITEMS)
    assert [r.n_hit for r in decontaminate.find_windows(docs_of(spark, [(1, "a b")]), empty).collect()] == [0]
    assert decontaminate.find_windows(docs_of(spark, []), empty).collect() == []


def test_windows_of_random_ids():
    draw = np.random.default_rng(1)
    for length in (1, 2, 3, 10):
        ids = draw.integers(1, 3, 3000).astype(np.int32)
        rows = draw.integers(1, 3, (40, length)).astype(np.int32)
        p = decontaminate.Patterns.build(rows, np.arange(40))
        first, pattern = p.find(ids)
        got = {(int(f), tuple(p.words[k].tolist())) for f, k in zip(first, pattern)}
        own = {tuple(r) for r in rows.tolist()}
        assert got == {(at, w) for at in range(len(ids) - length + 1) if (w := tuple(ids[at : at + length].tolist())) in own} and len(got) == len(first)
        assert all(tuple(rows[i].tolist()) == tuple(p.words[k].tolist()) for k in range(len(p.words)) for i in p.owners[p.owner_at[k] : p.owner_at[k + 1]])


# ---- prefix trie


def plain_trie(rows):
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    turns = {c: [(r, t) for _, r, t in sorted(ts)] for c, ts in turns.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        built[c] = turns.get(base, [])[:h] + own[h:]
    nodes = {}
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            nodes.setdefault(tuple(ts[:d]), []).append(c)
    children = Counter(k[:-1] for k in nodes if k)
    leaves, saved = Counter(), Counter()
    for k, members in nodes.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(members) - 1) * len(k[-1][1]) if k else 0
    out = []
    for k, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(built[c]) == len(k))
        out.append((min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), children[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found_trie(spark, rows):
    got = prefixtrie.prefix_trie(spark.createDataFrame([(*r, 5, 6) for r in rows], TURNS))
    return sorted((tuple(r) for r in got.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=str)


def test_trie_of_random_conversations(spark, monkeypatch):
    monkeypatch.setattr(prefixtrie, "BLOCK", 3)
    monkeypatch.setattr(prefixtrie, "IDS", 4)
    monkeypatch.setattr(prefixtrie, "CHAIN", 5)
    draw = random.Random(2)
    rows = []
    for c in [*range(0, 40), *range(95, 140), *range(-120, -80), 700]:
        for t in range(draw.choice([1, 2, 4, 9])):
            rows.append((c, draw.choice([None, t, t]), draw.choice(["user", None]), draw.choice(["hi", "éß😀", None])))
    rows += [(150, t, "user", f"turn {t}") for t in range(60)] + [(151, t, "user", f"turn {t}") for t in range(70)]
    rows += [(None, 0, "user", "no conversation"), (5, 1, "user", "hi"), (5, 1, "user", "hi")]
    draw.shuffle(rows)
    assert found_trie(spark, rows) == plain_trie(rows)


def test_trie_of_odd_tables(spark):
    assert found_trie(spark, []) == []
    assert found_trie(spark, [(None, 1, "a", "b")]) == []
    one = [(7, 0, "user", "x" * 3_000_000), (7, 1, None, None)]
    assert found_trie(spark, one) == plain_trie(one)
    copies = [(c, t, "user", f"same {t}") for c in range(1000, 1100) for t in range(3)]
    assert found_trie(spark, copies) == plain_trie(copies)


# ---- training samples and packing


def test_near_copies_share_a_fold():
    from riskweave.llm import toxicity

    draw = random.Random(4)
    vocabulary = ["".join(draw.choice("abcdefghij") for _ in range(6)) for _ in range(400)]
    texts, group = [], []
    for g in range(40):
        words = [draw.choice(vocabulary) for _ in range(80)]
        for _ in range(draw.randint(1, 4)):
            texts.append(" ".join(words) + (" " + draw.choice(vocabulary) if draw.random() < 0.3 else ""))
            group.append(g)
    sample = toxicity.Sample(texts)
    folds = {}
    for text, g, fold in zip(texts, group, sample.fold):
        folds.setdefault((g, toxicity.copies_key(toxicity.tokens(text))), set()).add(int(fold))
    assert all(len(f) == 1 for f in folds.values()) and len(set(sample.fold.tolist())) == toxicity.FOLDS
    spread = Counter(len({int(f) for h, f in zip(group, sample.fold) if h == g}) for g in range(40))
    assert spread[1] >= 36  # a near copy whose least hashes changed may be elsewhere


def test_sampled_texts_stay_within_bytes(spark):
    from riskweave.llm.common import sampled_texts

    docs = docs_of(spark, [(k, "x" * (100 if k % 5 else 5000)) for k in range(40)] + [(1, "a" * 90), (99, None)])
    got = sampled_texts(docs, {0: list(range(20)), 1: list(range(20, 40))}, "doc_id", "text", 4000)
    assert sum(map(len, got.values())) <= 4000 and len(got) > 25 and got[1] == "a" * 90 and 0 not in got
    assert sampled_texts(docs, {0: list(range(40))}, "doc_id", "text", 1 << 30).keys() == set(range(40))
    assert sampled_texts(docs, {}, "doc_id", "text", 10) == {}


def test_reduction_fixes_pairs_of_any_length():
    from riskweave.llm import packing

    lengths = np.random.default_rng(0).integers(200, 1200, 20_000)
    slots, told = packing.plan(Counter(lengths.tolist()), 2048)
    assert told["fixed_by_reduction"] >= 3000 and told["sequences"] <= 6870
    draw = random.Random(1)
    for _ in range(200):
        c = draw.randint(6, 40)
        items = Counter(draw.randint(1, c) for _ in range(draw.randint(1, 40)))
        slots, told = packing.plan(items, c)
        filled, used = Counter(), Counter()
        for size, rank, count, first, offset in slots.tolist():
            used[size] += count
            for k in range(first, first + count):
                filled[k] += size
        assert used == items and max(filled.values()) <= c and len(filled) == told["sequences"] >= told["at_least"]
