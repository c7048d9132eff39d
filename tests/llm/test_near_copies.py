"""Near copies are told by exact shingle sets."""

import re

import numpy as np
import pytest

from riskweave.llm import simhash


def changed(words, spots, tag):
    """`words` with new words at isolated spots: each changes five shingles."""
    own = list(words)
    for i in spots:
        own[i] = f"{tag}{i}"
    return own


def test_near_duplicates_are_those_of_the_exact_shingle_sets(spark):
    rng = np.random.default_rng(8)
    rows, expected = [], []
    for k in range(120):
        base = [f"v{i}" for i in rng.integers(0, 10**6, 404)]
        # 400 shingles; 8 changes leave 360/440 = 0.818, 9 leave 355/445 = 0.798
        n = 8 if k % 2 else 9
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(changed(base, range(10, 10 + 20 * n, 20), "x")))]
        expected += [2 * k] if n == 8 else [2 * k, 2 * k + 1]
    # copies of one text that are alike only through it: pairwise about 0.68
    base = [f"u{i}" for i in range(404)]
    rows.append((1000, " ".join(base)))
    rows += [(1000 + c, " ".join(changed(base, range(10 + 2 * c, 170, 20), f"y{c}"))) for c in range(1, 9)]
    expected.append(1000)
    docs = spark.createDataFrame([(i, t, "en", "a") for i, t in rows], "doc_id long, text string, lang string, source string")
    assert sorted(r.doc_id for r in simhash.stage_simhash(spark, docs, "").collect()) == expected


def bits_apart(a, b):
    return sum((x ^ y).bit_count() for x, y in zip(a, b))


def test_crossing_pairs_of_a_large_bucket_are_all_pairs_of_unlike_roots(spark, monkeypatch):
    """One bucket with most rows, most of them of one root, small ones, and one that is linked throughout."""
    monkeypatch.setattr(simhash, "STAGE_BUCKET", 32)
    monkeypatch.setattr(simhash, "HOT", 100)
    rng = np.random.default_rng(21)
    rows = []
    for k, n in ((7, 500), (-3, 2), (8, 40), (9, 1), (10, 60)):
        centre = rng.integers(-(2**63), 2**63, 2)
        for i in range(n):
            own = centre ^ (np.int64(1) << rng.integers(0, 60, 2)) ^ (np.int64(1) << rng.integers(0, 60, 2))
            root = 0 if k == 10 or (k == 7 and i % 5) else int(rng.integers(0, 30))
            rows.append((k, 1000 * k + i, root, *(int(x) for x in own)))
    expected = set()
    for x in rows:
        for y in rows:
            if x[0] == y[0] and x[1] < y[1] and x[2] != y[2] and bits_apart(x[3:], y[3:]) <= 7:
                expected.add((x[1], y[1]))
    entries = spark.createDataFrame(rows, "k long, cls long, root long, w0 long, w1 long")
    got = [tuple(r) for r in simhash.crossing_pairs(entries, 7, 2).collect()]
    assert set(got) == expected and len(expected) > 1000
    # two strays of one bucket may meet in both of their groups, but each pair is reported once for each bucket
    assert len(got) == len(set(got))


def test_a_bucket_is_never_one_task(spark, monkeypatch):
    """However large a bucket, what is compared at a time is one group and one block."""
    monkeypatch.setattr(simhash, "STAGE_BUCKET", 64)
    n = 4000
    bucket = spark.range(n).selectExpr("1L AS k", "id AS cls", "id % 7 AS root", "id AS w0")
    plan = simhash.crossing_pairs(bucket, 0, 1)._jdf.queryExecution().analyzed()
    met = plan.child() if plan.nodeName() == "MapInArrow" else plan.children().head()
    rows = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, met)
    most = max(r.getLong(1) for r in rows.groupBy("key", spark._jvm.PythonUtils.toSeq([])).count().collect())
    assert most <= 4 * 64


def test_classes_are_named_by_128_bits_of_their_words():
    assert simhash.class_of("A b\n c") == simhash.class_of("a  B c ") != simhash.class_of("ab c")
    assert len(simhash.class_of(None)) == 16 and simhash.class_of(None) == simhash.class_of(" \t")


def near_but_unlike(n, seed):
    """Copies of one text each with four isolated changes of its own: 180 of 220 shingles of the text are kept, and two copies have 160 to 170 of 220 to 240 in common."""
    rng = np.random.default_rng(seed)
    base = [f"u{i}" for i in range(204)]
    return [" ".join(changed(base, sorted(rng.choice(np.arange(5, 195, 10), 4, replace=False)), f"y{c}-")) for c in range(n)]


def entries_of(spark, texts):
    """One bucket with all texts, every one a root of its own, and their sets."""
    got = [simhash.shingle_hashes(t)[0] for t in texts]
    rows = [(1, i, i, 8 * len(h), *(simhash.signed(w) for w in simhash.wide_bits(h))) for i, h in enumerate(got)]
    schema = "k long, cls long, root long, m long, " + ", ".join(f"w{k} long" for k in range(simhash.STAGE_WORDS))
    return spark.createDataFrame(rows, schema), spark.createDataFrame([(i, bytearray(h.tobytes())) for i, h in enumerate(got)], "node long, s binary"), got


def test_a_bucket_of_unlike_near_copies_makes_no_rows(spark):
    entries, sets, got = entries_of(spark, near_but_unlike(300, 3))
    radius = simhash.stage_radius()
    # so many pairs lie within the radius that they would be written, were they not compared where they meet
    assert simhash.crossing_pairs(entries.drop("m"), radius).count() > 20_000
    alike = {(a, b) for a in range(300) for b in range(a) if simhash.jaccard(got[a], got[b]) >= 0.8}
    assert len(alike) < 300
    assert simhash.crossing_links(entries, sets, radius).count() <= len(alike)


@pytest.mark.parametrize("size, some", [(4096, 1 << 25), (16, 1 << 25), (4096, 30_000)])
def test_crossing_links_join_what_all_pairs_join(spark, monkeypatch, size, some):
    monkeypatch.setattr(simhash, "STAGE_BUCKET", size)
    monkeypatch.setattr(simhash, "STAGE_BYTES", some)
    rng = np.random.default_rng(12)
    base = [[f"{c}{i}" for i in range(204)] for c in "uv"]
    texts = [" ".join(changed(base[c % 2], sorted(rng.choice(np.arange(5, 195, 10), int(rng.integers(1, 5)), replace=False)), f"y{rng.integers(0, 9)}-")) for c in range(120)]
    texts = sorted(set(texts))
    entries, sets, got = entries_of(spark, texts)
    label = np.arange(len(texts))
    pairs = [(a, b) for a in range(len(texts)) for b in range(a) if simhash.jaccard(got[a], got[b]) >= 0.8]
    simhash.merge(label, *np.array(pairs).T)
    found = [tuple(r) for r in simhash.crossing_links(entries, sets, simhash.stage_radius()).collect()]
    mine = np.arange(len(texts))
    simhash.merge(mine, *np.array(found).T)
    assert (mine == label).all() and 2 <= len(set(label.tolist())) < len(texts)


def test_alike_sets_by_products_and_one_by_one():
    rng = np.random.default_rng(4)
    draw = lambda: [np.unique(rng.choice(60, int(n), replace=False)).astype(np.uint64) for n in rng.integers(0, 60, 40)]
    left, right = draw() + [np.zeros(0, np.uint64), np.arange(60, dtype=np.uint64)], draw() + [np.zeros(0, np.uint64), np.arange(50, dtype=np.uint64)]
    expected = np.array([[simhash.jaccard(x, y) >= 0.8 for y in right] for x in left])
    whole = np.ones(expected.shape, bool)
    assert (simhash.alike_sets(left, right, whole, width=7) == expected).all() and expected.sum() > 5
    few = rng.random(expected.shape) < 0.05
    assert (simhash.alike_sets(left, right, few)[few] == expected[few]).all()


def test_fingerprint_pairs_span_what_lies_within_the_radius(spark):
    rng = np.random.default_rng(6)
    rows = []
    for k, centre in enumerate(rng.integers(-(2**63), 2**63, 12)):
        for i in range(30):
            fp = int(centre)
            for bit in rng.integers(0, 62, int(rng.integers(0, 3))):
                fp ^= 1 << int(bit)
            rows.append((100 * k + i, fp))
    got = [tuple(r) for r in simhash.fingerprint_pairs(spark.createDataFrame(rows, "cls long, fp long")).collect()]
    of = dict(rows)
    assert all(a < b and (of[a] ^ of[b]).bit_count() <= simhash.RADIUS for a, b in got)
    place = {c: k for k, c in enumerate(of)}
    mine, label = np.arange(len(of)), np.arange(len(of))
    simhash.merge(mine, *np.array([(place[a], place[b]) for a, b in got]).T)
    pairs = [(place[a], place[b]) for a in of for b in of if a < b and bits_apart([of[a]], [of[b]]) <= simhash.RADIUS]
    simhash.merge(label, *np.array(pairs).T)
    assert (mine == label).all()


def test_the_stage_links_by_simhash_pigeonholes(spark, monkeypatch):
    """Near copies are found by their fingerprints alone: here the bands' buckets have no pairs at all."""
    base = [f"u{i}" for i in range(1000)]
    rows = [(0, " ".join(base)), (1, " ".join(changed(base, [500], "x"))), (2, " ".join(f"z{i}" for i in range(1000)))]
    monkeypatch.setattr(simhash, "bucket_pairs", lambda entries, *_: entries.selectExpr("k", "cls AS a", "cls AS b").where("false"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.stage_simhash(spark, docs, "").collect()) == [0, 2]


def python_steps(plan):
    """The most Python steps on a path of a plan's text that has no exchange."""
    most, above = 0, {}  # steps above and at each depth
    for line in plan.splitlines():
        depth = len(re.match(r"[ :+|-]*", line).group())
        steps = max(((d, n) for d, n in above.items() if d < depth), default=(0, 0))[1]
        steps = 0 if "Exchange" in line else steps + ("MapInArrow" in line)
        above = {d: n for d, n in above.items() if d < depth} | {depth: steps}
        most = max(most, steps)
    return most


@pytest.mark.parametrize("size", [4096, 8])
def test_a_task_of_the_stage_has_one_python_step(spark, monkeypatch, size):
    """Two in a row are two Python workers a core, and an executor keeps as many until it ends."""
    steps, write = [], simhash.materialize

    def materialize(df):
        steps.append(python_steps(df._jdf.queryExecution().executedPlan().toString()))
        return write(df)

    monkeypatch.setattr(simhash, "STAGE_BUCKET", size)
    monkeypatch.setattr(simhash, "materialize", materialize)
    rng = np.random.default_rng(4)
    rows = []
    for k in range(3):
        base = [f"v{i}" for i in rng.integers(0, 10**6, 404)]
        # fourteen changes leave 330/470 = 0.70, one leaves 395/405 = 0.975
        rows += [" ".join(changed(base, range(10, 10 + 20 * 14, 20), f"x{c}")) for c in range(12)]
        rows += [" ".join(base), " ".join(changed(base, [200], "y"))]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    kept = simhash.stage_simhash(spark, docs, "")
    steps.append(python_steps(kept._jdf.queryExecution().executedPlan().toString()))
    assert kept.count() == 39
    assert max(steps) == 1
