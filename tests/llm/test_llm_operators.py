"""Each operator against a plain version, and the cases its docstring defines."""

import hashlib
import json
import math
import re
import struct
import time
import zlib
from collections import Counter, defaultdict
from html import unescape

import numpy as np
import pytest
import xxhash
from pyspark.sql import Row
from pyspark.sql import functions as F

from riskweave.llm import common, extract, langid, mixing, mpeg, packing, quality, simhash, topk, toxicity, urlfilter
from riskweave.llm.dom import parse
from riskweave.llm.queries import ORACLES, QUERIES
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, size string, key string, rank string, fp string"


def docs_of(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, lang, src, None, "x", "y", "z", "r", "f") for i, t, lang, src in rows], DOCS)


ODD = [
    (1, None, None, None),
    (2, "", "en", ""),
    (3, "   \n\t ", "en", "a"),
    (4, "one", "en", "a"),
    (4, "one", "en", "a"),
    (5, "Ünïcödé çàfé 日本 😀 \u2003 end", "fr", "b"),
    (6, "the same words again and again " * 3000, "en", "b"),
    (None, "no id here at all", None, "b"),
    (7, "one two three four five six seven eight nine ten", "en", None),
    (8, "one two three four five six seven eight nine ten", "en", None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return docs_of(spark, ODD)


@pytest.fixture(scope="module")
def none(spark):
    return docs_of(spark, [])


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    assert compare(spark, connect(SF), QUERIES[name], ORACLES[name], SF) == ""


# --- 1: extraction ---------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def extractor():
    return extract.train()


def test_extract_page(extractor):
    page = """<!doctype html><html><head><title>t</title><style>p{}</style></head><body><header><a href=/>Site</a></header>
      <nav><ul><li><a href=1>Home</a></li><li><a href=2>News</a></li></ul></nav><div class="cookie-notice"><p>We use cookies, do you agree?</p></div>
      <article><h1>A  title &amp; more</h1><p><b>First paragraph, with
      some text.<br>Same block.<p>Second&nbsp;paragraph is here, and it goes on.</p><div class="ad">Buy this now</div><script>var x="</p>";</script>
      <p>Third paragraph, the last one of the article.</p></article><aside class="sidebar"><p>Related stories for you</p></aside>
      <section id="comments"><div class="comment"><p>Nice article, thanks a lot.</p></div></section><form><label>Mail</label><input></form><footer>&copy; Site</footer>"""
    assert extract.main_texts(extractor, [page])[0].split("\n\n") == [
        "A title & more", "First paragraph, with some text. Same block.", "Second paragraph is here, and it goes on.", "Third paragraph, the last one of the article.",
    ]


def test_extract_decoding_is_consistent_and_accurate(extractor):
    wrong = 0
    for k in range(60):
        nodes = extract.parse(extract._Writer(77_000_000 + k).page())
        kept = extract.decode(nodes, extractor.trees.log_odds(extract.features(nodes, extractor.tokens)))
        for i, x in enumerate(nodes):
            assert not kept[i] or i == 0 or kept[x.parent]
            assert not kept[i] or x.text or any(kept[j] for j in range(i + 1, len(nodes)) if nodes[j].parent == i)
        want = [x.text for x, y in zip(nodes, extract.holds_main(nodes)) if y and x.text]
        wrong += want != [x.text for x, y in zip(nodes, kept) if y and x.text]
    assert wrong <= 9


def annotated(html):
    """The main text of the sample's pages as read by eye: the article's title and paragraphs, nothing around it."""
    article = re.search(r"<article>(.*?)</article>", html, re.DOTALL)
    parts = (" ".join(unescape(re.sub(r"<[^>]+>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", article[1]))
    return "\n\n".join(x for x in parts if x)


def test_extract_query_against_annotated_pages(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = extract.op1_extract(spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        html = pages[r.page_id].html
        assert r.n_chars == len(r.text) and r.url == pages[r.page_id].url
        assert r.text == (annotated(html) if html and "<article>" in html else r.text)


@pytest.mark.parametrize("piece", ["<div>", "<span><div></b></i>", "<p><b><i></p>", "<table><tr><td>", "<a '", "<ul><li>", "</script"])
def test_parser_is_linear(piece):
    def took(n):
        began = time.perf_counter()
        parse(piece * n)
        return time.perf_counter() - began

    took(1000)
    assert took(40_000) < 40 * max(took(4_000), 0.002)


def test_extract_long_and_repeated_pages(spark, extractor):
    long = "<article><h1>Title</h1>" + "".join(f"<p>Paragraph {k}, a sentence that goes on for some words.</p>" for k in range(20_000)) + "</article>"
    assert extract.main_texts(extractor, [long])[0].endswith("Paragraph 19999, a sentence that goes on for some words.")
    page = "<body><nav><a href=x>Home</a></nav><article><h1>A title</h1><p>The text of this page, a whole sentence.</p></article></body>"
    frame = spark.createDataFrame([(7, "u", page, "x"), (7, "u", page, "x")], "page_id long, url string, html string, text string")
    assert [(r.page_id, r.text) for r in extract.extract_pages(frame).collect()] == [(7, "A title\n\nThe text of this page, a whole sentence.")] * 2


def test_extract_decode_is_the_best_labelling(extractor):
    """Against all consistent labellings of small trees."""
    rng = np.random.default_rng(3)
    for _ in range(150):
        n = int(rng.integers(2, 9))
        nodes = [extract.Node("html", -1, 0)] + [extract.Node("div", int(rng.integers(0, i)), 0, text="x" if rng.random() < 0.5 else "") for i in range(1, n)]
        odds = rng.normal(0, 2, n)
        keep, drop = -np.log1p(np.exp(-odds)), -np.log1p(np.exp(odds))
        best = -np.inf
        for mask in range(2**n):
            y = [bool(mask >> i & 1) for i in range(n)]
            if all(not y[i] or (i == 0 or y[nodes[i].parent]) and (nodes[i].text or any(y[j] for j in range(i + 1, n) if nodes[j].parent == i)) for i in range(n)):
                best = max(best, sum(keep[i] if y[i] else drop[i] for i in range(n)))
        got = extract.decode(nodes, odds)
        assert sum(keep[i] if got[i] else drop[i] for i in range(n)) == pytest.approx(best)


def test_extract_odd_pages(spark, extractor):
    pages = [None, "", "<", "<p", "<!-- <p>never closed", "<script>x", "</div></p>", "<div>" * 3000 + "deep", "\x00<p>a</p>"]
    assert len(extract.main_texts(extractor, pages)) == len(pages)
    frame = spark.createDataFrame([(1, None, None, "x"), (1, "u", "", "x"), (None, "u", "<p>", "x")], "page_id long, url string, html string, text string")
    got = extract.extract_pages(frame).collect()
    assert [r.n_chars for r in got] == [0, 0, 0] and all(r.text == "" for r in got)
    assert extract.extract_pages(frame.where("false")).collect() == []


# --- 2: mixing ---------------------------------------------------------------------------------------


def test_mixing_takes_each_target(spark, odd):
    rows = mixing.mixed_documents(odd).collect()
    assert len(rows) == len(ODD)
    by = defaultdict(list)
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        by[r.source].append(r)
    for own in by.values():
        assert sum(r.taken for r in own) == int(own[0].target) and own[0].target <= 2 * own[0].source_size
    total = sum(r.size for r in rows)
    assert sum(own[0].target for own in by.values()) == pytest.approx(1.5 * total)


def test_mixing_empty_and_without_words(spark, none):
    assert mixing.mixed_documents(none).collect() == []
    rows = mixing.mixed_documents(docs_of(spark, [(1, None, None, "a"), (2, "", None, "b")])).collect()
    assert [(r.size, r.target, r.taken) for r in rows] == [(0, 0.0, 0)] * 2


def test_mixing_stage_repeats_whole_documents(spark, odd):
    taken = {(r.doc_id, r.source, r.size): r.taken for r in mixing.mixed_documents(odd).collect()}
    out = mixing.stage_mix(spark, odd, "")
    assert out.columns == odd.columns
    count = Counter((r.doc_id, r.source) for r in out.collect())
    for (i, src, size), t in taken.items():
        if size and i != 4:
            assert count[i, src] == -(-t // size)


# --- 3: media -----------------------------------------------------------------------------------------


@pytest.mark.parametrize("text", [None, "", "a", "x" * 64, "é" * 5000, "\x00" * 100, "\xff\xfa" * 3000])
def test_media_round_trip(text):
    payload, n = mpeg.padded(text)
    assert len(payload) % 64 == 0 and len(payload) > 0 and payload[:n] == (text or "").encode() and not payload[n:].strip(b"\x00")
    m = mpeg.decode(mpeg.encode(payload))
    assert m.payload == payload and m.skipped == 0 and m.bad_checksums == 0 and m.vbr_frames == m.frames
    assert m.duration_us == m.frames * 1152 * 1_000_000 // 48000


def test_media_resynchronises_and_sees_damage():
    payload, _ = mpeg.padded("some text " * 2000)
    data = bytearray(mpeg.encode(payload))
    at = mpeg.decode(bytes(data)).seek[2]
    assert mpeg.decode(bytes(data[:at] + b"\xff\xfajunk\xff\x00" * 3 + data[at:])).payload == payload
    data[at + 8] ^= 1  # in the side information
    assert mpeg.decode(bytes(data)).bad_checksums == 1


def other_reader(data):
    """The stored form read by other means: tag, first frame's header fields, then frame after frame."""
    assert data[:3] == b"ID3"
    size = (data[6] << 21) + (data[7] << 14) + (data[8] << 7) + data[9]
    length = int.from_bytes(data[10 + size - 8 : 10 + size], "big")
    at, rates, out, offsets = 10 + size, [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320], b"", []
    start, vbr = at, None
    while at < len(data):
        assert data[at] == 0xFF and data[at + 1] == 0xFA and data[at + 3] >> 6 == 3
        n = 144 * rates[data[at + 2] >> 4] // 48
        crc = 0xFFFF
        for bit in "".join(f"{b:08b}" for b in data[at + 2 : at + 4] + data[at + 6 : at + 23]):
            crc = (crc << 1 & 0xFFFF) ^ (0x8005 if (crc >> 15) ^ int(bit) else 0)
        assert crc == struct.unpack(">H", data[at + 4 : at + 6])[0]
        if vbr is None:
            vbr = struct.unpack(">4sIII100B", data[at + 23 : at + 139])
        else:
            offsets.append(at)
            out += data[at + 23 : at + n]
        at += n
    assert at == len(data) and vbr[:4] == (b"Xing", 7, len(offsets), len(data) - start)
    for p in range(100):
        assert vbr[4 + p] == min(255, (offsets[p * len(offsets) // 100] - start) * 256 // (len(data) - start))
    return out[:length], offsets


def test_media_query_against_another_reader(spark):
    stored = {r.doc_id: r.media for r in mpeg.store_media(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    for r in mpeg.op3_media(spark, SF).collect():
        payload, offsets = other_reader(stored[r.doc_id])
        assert hashlib.sha256(payload).hexdigest() == r.payload_sha256 and zlib.crc32(payload[-64:]) == r.tail_crc32
        assert list(r.seek_offsets) == offsets and r.duration_us == len(offsets) * 24_000 and "/0;bad=0;skipped=0;missing=0" in r.feature


def test_media_damage_never_raises():
    rng = np.random.default_rng(3)
    data = mpeg.encode(mpeg.padded("some text \xff\xfa " * 120)[0])
    for k in range(len(data)):
        mpeg.decode(data[:k])
    for _ in range(500):
        hurt = bytearray(data)
        for at in rng.integers(0, len(data), 3):
            hurt[at] = int(rng.integers(0, 256))
        mpeg.decode(bytes(hurt))
    assert mpeg.decode(data[:-400]).missing > 0 and mpeg.decode(data).missing == 0
    wrong = bytearray(data)
    wrong[data.index(b"Xing") + 8 + 3] ^= 1  # the frame count
    assert mpeg.decode(bytes(wrong)).vbr_wrong == 1


def test_media_query(spark, odd, none):
    got = {r.doc_id: r for r in mpeg.read_media(mpeg.store_media(odd)).collect()}
    for i, t, _, _ in ODD:
        payload, n = mpeg.padded(t)
        assert got[i].payload_sha256 == hashlib.sha256(payload).hexdigest() and got[i].n_bytes == n and got[i].tail_crc32 == zlib.crc32(payload[-64:])
    assert got[7].media_sha256 == got[8].media_sha256 and got[7].feature == got[8].feature
    assert mpeg.read_media(mpeg.store_media(none)).collect() == []


# --- 4: language ID -----------------------------------------------------------------------------------


def plain_phrases(reference, text):
    at = count = 0
    while at < len(text):
        n = 1
        while at + n < len(text) and text[at : at + n + 1] in reference and text[at : at + n] in reference:
            n += 1
        at, count = at + n, count + 1
    return count


def letters(text):
    """A text as the parser reads it: folded letters, runs of other characters as one space."""
    return re.sub(" +", " ", "".join(c.lower() if c.isalpha() else " " for c in text))


@pytest.mark.parametrize("block", [7, 300, 2048, 10**6])
@pytest.mark.parametrize("more", ["", "".join(map(chr, range(0x4E00, 0x4E50)))])
def test_phrases_match_substring_search(block, more):
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdé" + more), int(rng.integers(1, 6))))
    text = lambda n: " ".join(word() for _ in range(n))
    samples = {"x": [text(80), text(9)], "y": [text(80)]}
    model = langid.train(samples)
    probes = [text(n) for n in (1, 3, 30, 3000)] + ["", "q", "zq a zz", "Éa", "abab" * 2500]
    count, length, known = langid.phrases(model, probes, block=block)
    for row, n, t in zip(count, length, probes):
        assert n == len(letters(t)) and row.tolist() == [plain_phrases(letters("\n".join(samples[k])), letters(t)) for k in ("x", "y")]
    # long texts in chunks, with gaps at their borders
    probes += [" . ".join(text(3) for _ in range(300)) + " , "]
    whole = langid.phrases(model, probes, block=block)
    for a, b in zip(whole, langid.phrases(model, probes, block=block, longest=50)):
        assert (a == b).all()


def test_languages_of_wide_scripts_and_none():
    rng = np.random.default_rng(11)

    def writer(first, last):
        vocabulary = ["".join(map(chr, rng.integers(first, last, rng.integers(1, 4)))) for _ in range(300)]
        return lambda n: "".join(rng.choice(vocabulary, n))

    write = {"ja": writer(0x3041, 0x30FB), "ko": writer(0xAC00, 0xD7A4), "zh": writer(0x4E00, 0x9FA6), "zz": writer(0x4E00, 0x9FA6)}
    model = langid.train({k: [w(2000)] for k, w in write.items()})
    texts = [(k, w(60)) for k, w in write.items() for _ in range(20)]
    assert np.mean([g == k for g, (k, _) in zip(langid.predict(model, [t for _, t in texts])[0], texts)]) > 0.95
    assert langid.predict(model, ["😀🚀", "、。！", "123 ...", ""]) [0] == ["und"] * 4


def test_language_sample_is_of_whole_rows(spark):
    rows = [(i, f"short text number {i} " + "word " * (i % 7), "en", None) for i in range(300)]
    rows += [(i, "lang " * 4000, "xx", None) for i in range(1000, 1012)] + [(i, "longer " * n, "yy", None) for i, n in zip(range(2000, 2008), (30_000, 20_000) * 4)]
    sample = langid.labelled_sample(docs_of(spark, rows), most=8, chars=80_000)
    texts = {t for _, t, _, _ in rows}
    assert len(sample["en"]) == 8 and set(sample["en"]) <= texts
    assert sample["xx"] == ["lang " * 4000] * 4  # long texts count like others, as many as fit
    assert sample["yy"] == ["longer " * 20_000]  # none fits


def test_langid_stage_drops_what_has_no_letters(spark, odd):
    kept = [r.doc_id for r in langid.stage_langid(spark, odd, "").collect()]
    assert set(kept) & {1, 2, 3} == set() and 6 in kept


def test_langid_odd(spark, odd, none):
    got = {r.doc_id: r for r in langid.identify(odd).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1, 2, 3))
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.identify(none).collect() == []
    assert {r.lang_pred for r in langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_langid_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = [r for r in langid.op4_langid(spark, d).collect() if r.held_out]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in rows]) > 0.98


# --- 5: URL filters -----------------------------------------------------------------------------------


def plain_verdict(url, rules, default="allow"):
    host, path = urlfilter.split_url(url)
    fits = [(h.count("."), len(h), len(p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (max(fits)[3], max(fits)[4]) if fits else (None, default)


def test_urlfilter_against_all_rules():
    rng = np.random.default_rng(5)
    labels, parts = ["org", "com", "a", "b", "example"], ["", "en", "es", "en1", "x"]
    pick = lambda pool, n: [pool[i] for i in rng.integers(0, len(pool), n)]
    for _ in range(200):
        rules = list({(h, p): ("allow", h, p) if rng.random() < 0.5 else ("block", h, p) for h, p in ((".".join(pick(labels, rng.integers(1, 4))), "/" + "/".join(pick(parts, rng.integers(1, 3)))) for _ in range(6))}.values())
        root = urlfilter.build(rules)
        for _ in range(10):
            url = "http://" + ".".join(pick(labels, rng.integers(1, 5))) + "/" + "/".join(pick(parts, rng.integers(1, 4)))
            found = urlfilter.judge(root, *urlfilter.split_url(url))
            assert (found or (None, "allow")) == plain_verdict(url, rules)


def test_urlfilter_odd(spark):
    rows = [(1, None), (1, ""), (None, "no scheme"), (2, "HTTP://A.Example.ORG/es/?q"), (3, "http://org"), (4, "x://example.org#/es/"), (5, "a://b://c.org/")]
    got = urlfilter.filter_urls(spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, host string")).collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in got] == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("a.example.org", "/es/", "example.org/es/", "block"), ("org", "", None, "allow"), ("example.org", "", None, "allow"), ("b:", "//c.org/", None, "allow"),
    ]


# --- 6, 7: classifiers ----------------------------------------------------------------------------------


def auc(y, s):
    y, s = np.asarray(y), np.asarray(s)
    return (s[y == 1][:, None] > s[y == 0][None, :]).mean() + 0.5 * (s[y == 1][:, None] == s[y == 0][None, :]).mean()


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = [r for r in quality.op6_quality(spark, d).collect() if r.held_out and r.doc_id in labels]
    assert auc([labels[r.doc_id] for r in rows], [r.score for r in rows]) > 0.95
    assert all(r.predicted == (r.score >= 0.7) for r in rows)


def test_quality_gradient():
    """Every parameter's gradient against differences of the loss."""
    rng = np.random.default_rng(0)
    bags = quality.passages(["a b c d " * 40, "x | y || z " * 30, "", "one two three"] * 2, buckets=64)
    y, p = np.array([1, 0, 1, 0, 1, 0, 0, 1.0]), quality.start(4, 64, 1)
    p["E"], p["d"] = rng.normal(0, 0.3, p["E"].shape), np.array(0.3)
    shape = bags.shape.astype(float)
    _, g = quality.gradients(p, shape, bags, y)
    for k in p:
        for _ in range(6):
            at = tuple(int(rng.integers(0, d)) for d in p[k].shape)
            at = (int(rng.choice(bags.bucket)), at[1]) if k == "E" else at
            loss = []
            for step in (1e-6, -1e-6):
                moved = p[k].copy()
                moved[at] += step
                loss.append(quality.gradients(p | {k: moved}, shape, bags, y)[0])
            assert (loss[0] - loss[1]) / 2e-6 == pytest.approx(g[k][at], abs=1e-6)


def plain_quality(model, text):
    """The score of one text, passage by passage."""
    p, words = model.weights, re.findall(r"[^ \t\n\r\x0b\x0c]+", text)
    cut = [" ".join(words[k : k + 64]) for k in range(0, max(1, len(words)), 64)]
    starts = [m.start() for m in re.finditer(r"[^ \t\n\r\x0b\x0c]+", text)][64::64]
    parts = [text[a:b] for a, b in zip([0, *starts], [*starts, len(text)])]
    assert len(parts) == len(cut)
    h, e = [], []
    for part in parts:
        bag = quality.passages([part])
        vector = np.mean([p["E"][b] for b in bag.bucket], axis=0) if len(bag.bucket) else 0
        x = np.tanh((bag.shape[0] - model.shift) / model.scale @ p["W"] + p["b"] + vector)
        h.append(x)
        e.append(float(np.tanh(x @ p["V"]) * (1 / (1 + np.exp(-x @ p["U"]))) @ p["w"]))
    a = np.exp(np.array(e) - max(e))
    return 1 / (1 + np.exp(-(float((a / a.sum()) @ np.array(h) @ p["c"]) + float(p["d"]))))


def test_quality_against_a_plain_score(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    sample, counts = quality.labelled_sample(docs, labels, "quality", quality.SAMPLE_DOCS)
    assert len(sample) == sum(counts.values())  # all rows, where there are no more than the bound
    model = quality.train([t for _, t, _ in sample], [y for _, _, y in sample], counts)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in quality.op6_quality(spark, SF).collect()[:60]:
        assert r.score == pytest.approx(plain_quality(model, texts[r.doc_id]), abs=1e-4)


def test_quality_of_long_texts_in_pieces():
    model = quality.train(["Good text here, it goes on. " * 9, "| $$ | ### " * 9] * 5, [1, 0] * 5, epochs=3)
    text = "Some words, and more of them. | $ | " * 900
    assert quality.score(model, [text, "a"], piece=1000) == pytest.approx(quality.score(model, [text, "a"]), abs=1e-5)
    assert b"".join(quality.long_pieces(text.encode(), 1000)) == text.encode()


def test_quality_passages_cover_the_text():
    bags = quality.passages(["", "a b c", "w " * 130, None or ""])
    assert bags.count.tolist() == [1, 1, 3, 1] and bags.shape[0].sum() == 0 and bags.words.tolist() == [0, 3, 64, 64, 2, 0]


def test_scores_do_not_depend_on_batching():
    texts = [" ", "a b", "", "  \n One two. Three!", "x | y | z " * 100, "\n\n", ""]
    model = quality.train(["good text here. " * 9, "| $$ | " * 9] * 5, [1, 0] * 5, epochs=3)
    assert np.allclose(quality.score(model, texts), [quality.score(model, [t])[0] for t in texts])


def test_classifiers_odd(spark, odd, none):
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 1), (None, 1, 1), (6, None, None), (4, 1, 0)], "doc_id long, quality int, toxic int")
    for f in (quality.score_quality, toxicity.score_toxicity):
        rows = f(odd, labels).collect()
        assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
        assert f(none, labels).collect() == [] and len(f(odd, labels.where("false")).collect()) == len(ODD)


def toxic_texts(n=400):
    rng = np.random.default_rng(7)
    words = ["".join(rng.choice(list("bdgklmn"), 5)) for _ in range(300)]
    text = lambda *more: " ".join([*rng.choice(words, 40), *more])
    texts, labels = [], []
    for k in range(n):
        toxic = k % 4 == 0
        texts.append(text(*(["vilest"] if k % 8 else [f"zorgu{words[k % 300]}"]) * (1 + k % 3)) if toxic else text())
        labels.append(int(toxic))
    return text, texts, labels


def test_toxicity_chain_learns_words_and_stems():
    text, texts, labels = toxic_texts()
    model = toxicity.train(texts, {"first": labels[::-1], "toxic": labels})
    p = toxicity.probabilities(model, [text("VILEST!!"), text("zorguwxyz"), text(), ""])
    assert p.shape == (4, 2) and (p[:2, -1] > 0.5).all() and (p[2:, -1] < 0.5).all()


def test_toxicity_out_of_fold_against_a_plain_chain():
    """The chain, one text and one fold at a time, from counters instead of arrays."""
    _, texts, labels = toxic_texts(120)
    first = [int(k % 3 == 0 or y) for k, y in enumerate(labels)]
    targets = {"first": first, "toxic": labels}
    counters = [toxicity.word_counts(t) for t in texts]

    def fitted(rows, y, earlier):
        sample = toxicity.Sample(texts)
        use = np.isin(np.arange(len(texts)), rows)
        chosen, terms = sample.choose(use, y)
        words, term = [sample.keys[k] for k in chosen], {sample.keys[k] for k in terms}

        def x(k):
            count, hits = Counter(), 0
            for w, n in counters[k].items():
                for key in toxicity.keys(w):
                    count[key] += n
                    hits += n * (key in term)
            return [*(math.log1p(count[w]) for w in words), math.log1p(hits), 100 * hits / max(1, counters[k].total()), *earlier[k]]

        weight = np.array([sample.weight[k] for k in rows])
        return toxicity.logistic(np.array([x(k) for k in rows]), y[rows], weight), x

    earlier = [[] for _ in texts]
    every = np.arange(len(texts))
    y = np.array(first, float)
    out = np.zeros(len(texts))
    for fold in range(toxicity.FOLDS):
        inside = every[every % toxicity.FOLDS != fold]
        w, x = fitted(inside, y, earlier)
        for k in every[every % toxicity.FOLDS == fold]:
            out[k] = 1 / (1 + math.exp(-(w[0] + np.dot(w[1:], x(k)))))
    model = toxicity.train(texts, targets)
    w, x = fitted(every, y, earlier)
    p_first = np.array([1 / (1 + math.exp(-(w[0] + np.dot(w[1:], x(k))))) for k in every])
    got = toxicity.probabilities(model, texts)
    assert got[:, 0] == pytest.approx(p_first, abs=1e-6)
    w, x = fitted(every, np.array(labels, float), [[v] for v in out])
    assert model.links[1].weights == pytest.approx(w, abs=1e-6)


def test_toxicity_near_copies_share_their_weight():
    base = "this is one long text of many words that will be copied with small changes " * 6
    sample = toxicity.Sample([base + str(k) for k in "abcdefgh"] + ["another text without anything in common with it at all"])
    assert sample.weight[-1] == 1 and sample.weight[:-1].sum() == pytest.approx(1)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_toxicity_held_out(spark, sf):
    d = f"/root/testdata/{sf}"
    labels = {r.doc_id: r for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = [r for r in toxicity.op7_toxicity(spark, d).collect() if r.held_out and r.doc_id in labels]
    hit = np.array([r.predicted for r in rows])
    y = np.array([labels[r.doc_id].toxic for r in rows])
    junk = np.array([labels[r.doc_id].quality == 0 for r in rows])
    assert hit[y == 1].mean() > 0.85 and hit[y == 0].mean() < 0.02
    assert auc(junk, [r.p_junk for r in rows]) > 0.5


def test_toxicity_stage_drops_toxic_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    kept = {r.doc_id for r in toxicity.stage_toxicity(spark, docs, "/root/testdata/sf0.01").collect()}
    toxic = [i for i, y in labels.items() if y]
    assert np.mean([i in kept for i in toxic]) < 0.15 and np.mean([i in kept for i, y in labels.items() if not y]) > 0.98


# --- shared helpers ----------------------------------------------------------------------------------------


def test_sampled_ids_are_all_rows_up_to_the_bound(spark):
    rows = spark.createDataFrame([(i, i % 2) for i in range(4000)], "i long, g int")
    ids, counts = common.sampled_ids(rows, F.col("g"), "i", {0: 5000, 1: 100}, F.lit(True), 1)
    assert counts == {0: 2000, 1: 2000} and sorted(ids[0]) == list(range(0, 4000, 2)) and len(set(ids[1])) == 100
    assert common.sampled_ids(rows.where("false"), F.col("g"), "i", 5, F.lit(True), 1) == ({}, {})


def test_text_chunks_cut_at_white_space():
    text = "word and another " * 400
    parts = list(common.text_chunks(text, 100))
    assert "".join(parts) == text and len(parts) > 10 and all(p[0] == " " for p in parts[1:])


# --- 8: SimHash -------------------------------------------------------------------------------------------


def plain_fingerprint(text, width=3):
    w = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + width]), 42) for i in range(max(1, len(w) - width + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def plain_components(fps, radius=3):
    fps = np.array(fps, np.uint64)
    label = np.arange(len(fps))
    close = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
    while True:
        new = np.array([label[c].min() for c in close])
        if (new == label).all():
            return label
        label = new


@pytest.mark.parametrize("large", [30, 512])
def test_simhash_links_dense_clusters(spark, large):
    rng = np.random.default_rng(8)
    centres = rng.integers(0, 2**63, 6, dtype=np.uint64)
    fps = [int(c) for c in rng.integers(0, 2**63, 80, dtype=np.uint64)] + [0]
    for c in centres:
        for _ in range(40):
            fps.append(int(c) ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 7)), replace=False)))
    fps = sorted({simhash.signed(f) for f in fps})
    frame = spark.createDataFrame([(f,) for f in fps], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(frame, large=large)).collect()}
    want = plain_components([f & (1 << 64) - 1 for f in fps])
    assert [roots.get(f, f) for f in fps] == [fps[k] for k in want]


def test_simhash_documents(spark, odd, none):
    got = {r.doc_id: r for r in simhash.near_duplicates(odd).collect()}
    for i, t, _, _ in ODD:
        assert got[i].fp & (1 << 64) - 1 == plain_fingerprint(t)
    assert got[1].component_id == got[2].component_id == got[3].component_id == 1
    assert got[8].component_id == 7
    assert simhash.near_duplicates(none).collect() == []


def test_long_texts_are_hashed_in_runs(monkeypatch):
    rng = np.random.default_rng(12)
    texts = [" ".join(f"W{v}" for v in rng.integers(0, 300, n)) for n in (1, 2, 3, 4, 5, 6, 40, 900)] + ["", "  ", "x" * 500, "a\u2003b \x85c " * 60]
    whole = [(simhash.fingerprint(t), *simhash.shingle_hashes(t)) for t in texts]
    monkeypatch.setattr(simhash, "LONG", 20)
    for t, (fp, hashes, name) in zip(texts, whole):
        got = simhash.shingle_hashes(t)
        assert (simhash.fingerprint(t), got[1]) == (fp, name) and (got[0] == hashes).all() and fp == plain_fingerprint(t)


def test_many_fingerprints_are_those_of_each_text(monkeypatch):
    rng = np.random.default_rng(3)
    made = ["".join(rng.choice(list("aBc\u00e9\u20ac\U0001f600"), n)) for n in range(1, 40)]
    texts = [" ".join(rng.choice(made, n)) for n in (1, 2, 3, 4, 5, 254, 255, 256, 257, 258, 600)] + [f"{w} x\t\n {w}" for w in made]
    texts += [None, "", " \t", "A", " a\x0bb\x0c", "x" * 500, "a\u2003b \x85c\x00 " * 60, *[t for _, t, _, _ in ODD]]
    want = [plain_fingerprint(t) for t in texts]
    assert simhash.many_fingerprints(texts).tolist() == want and [int(simhash.many_fingerprints([t])[0]) for t in texts] == want
    monkeypatch.setattr(simhash, "LONG", 100)
    assert simhash.many_fingerprints(texts).tolist() == want
    assert simhash.many_fingerprints([]).tolist() == []


def test_the_sample_of_fingerprints_is_of_all_values(spark, monkeypatch):
    """A sample of the least fingerprints has its leading bits alike; their partitions seemed crowded, so others were probed
    within one bit, and all of their values had so many entries that they were partitioned again."""
    seen, groups = [], simhash.bit_groups
    monkeypatch.setattr(simhash, "bit_groups", lambda bits, *rest: seen.append(bits) or groups(bits, *rest))
    frame = spark.range(300_000).selectExpr("xxhash64(id) AS fp")
    simhash.links(frame, sample=1024)
    assert abs(seen[0].mean(axis=0) - 0.5).max() < 0.1
    assert simhash.thresholds(seen[0], groups(seen[0], list(range(64)), 4), 3, 3_000_000) == [0, 0, 0, 0]


@pytest.mark.parametrize("small", [0, 3, 128])
@pytest.mark.parametrize("real", [False, True])
def test_buckets_compared_together_have_the_same_components(spark, monkeypatch, small, real):
    monkeypatch.setattr(simhash, "SMALL_BUCKET", small)
    rng = np.random.default_rng(5)
    keys = np.sort(rng.integers(0, 400, 3000))
    fps = rng.integers(0, 2**63, 400, dtype=np.uint64)[keys] ^ (np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64))
    keys[keys > 390], probe = 390, rng.random(3000) < 0.3
    starts = np.append(0, np.flatnonzero(np.diff(keys)) + 1)
    got = simhash.closed_buckets(fps, probe, starts, 3, real)
    want = [simhash.forest(fps[a:b], probe[a:b], 3) for a, b in zip(starts[:-1], starts[1:])]
    nodes, labels = np.unique(fps), []
    for edges in (np.concatenate(got), np.concatenate(want)):
        label = np.arange(len(nodes))
        simhash.merge(label, *np.searchsorted(nodes, edges).T)
        labels.append(label)
    assert (labels[0] == labels[1]).all() and len(np.unique(labels[0])) < len(nodes)
    assert not real or (np.bitwise_count(np.bitwise_xor(*np.concatenate(got).T)) <= 3).all()


def test_thresholds_obey_the_pigeonhole():
    rng = np.random.default_rng(1)
    bits = (rng.random((500, 64)) < np.where(np.arange(64) < 16, 0.02, 0.5)).astype(np.uint8)
    groups = simhash.bit_groups(bits, list(range(64)), 4)
    assert sorted(b for g in groups for b in g) == list(range(64))
    t = simhash.thresholds(bits, groups, 3, 10**6)
    assert sum(x + 1 for x in t) == 4 and min(t) >= -1


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 4000), (4000, 4500)]
    roots = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {roots[i] for i in range(201)} == {0} and {roots[1000 + i] for i in range(300)} == {1000} and roots[5000] == roots[4500] == 4000


def test_simhash_stage(spark, none):
    rng = np.random.default_rng(2)
    vocabulary = ["w%d" % i for i in range(900)]
    base = [list(rng.choice(vocabulary, 250)) for _ in range(12)]
    rows, group = [], {}
    for k, words in enumerate(base):
        for c in range(4):
            own = list(words)
            for _ in range(c and 2):
                own[int(rng.integers(0, 250))] = "edit%d" % rng.integers(0, 99)
            rows.append((100 * k + c, " ".join(own), "en", "a"))
            group[100 * k + c] = k
    rows += [(9000, "x y", "en", "a"), (9000, "x y", "en", "a")]
    kept = [r.doc_id for r in simhash.stage_simhash(spark, docs_of(spark, rows), "").collect()]
    assert sorted(kept) == [100 * k for k in range(12)] + [9000]
    assert simhash.stage_simhash(spark, none, "").collect() == []


def brute_groups(rows):
    """The least id of each group of texts linked by a Jaccard similarity of 0.8 on five-word shingles."""
    texts = defaultdict(list)
    for i, t in rows:
        texts[t].append(i)
    sets = []
    for t in texts:
        w = t.encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(sets)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            union = len(sets[a] | sets[b])
            if union == 0 or len(sets[a] & sets[b]) / union >= 0.8:
                label[root(a)] = root(b)
    groups = defaultdict(list)
    for k, ids in enumerate(texts.values()):
        groups[root(k)] += ids
    return sorted(min(g) for g in groups.values())


@pytest.mark.parametrize("bucket", [4096, 16])
def test_simhash_stage_against_all_pairs(spark, monkeypatch, bucket):
    """Clusters whose ends aren't alike, with buckets compared whole and in parts."""
    monkeypatch.setattr(simhash, "STAGE_BUCKET", bucket)
    rng = np.random.default_rng(5)
    rows = []
    for k in range(4):
        base = [f"v{i}" for i in rng.integers(0, 10**6, 204)]
        for _ in range(40):
            own = list(base)
            for at in rng.choice(200, int(rng.integers(0, 9)), replace=False):
                own[at] = f"e{rng.integers(0, 10**6)}"
            rows.append((len(rows), " ".join(own)))
    got = simhash.stage_simhash(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(r.doc_id for r in got) == brute_groups(rows)


@pytest.mark.parametrize("share", [0.80, 0.85, 0.90])
def test_simhash_stage_recall_at_planted_similarities(spark, share):
    """Pairs whose shingle sets have just this similarity: every one is found."""
    rng = np.random.default_rng(int(100 * share))
    rows = []
    for k in range(150):
        n = 400
        new = math.floor(n * (1 - share) / (1 + share))  # shingles that differ on each side
        words = [f"v{i}" for i in rng.integers(0, 10**7, n + 4)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join([*words[: n + 4 - new], *(f"x{k}-{i}" for i in range(new))]))]
    kept = simhash.stage_simhash(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(r.doc_id for r in kept) == list(range(0, 300, 2))


def test_hot_fingerprints_are_joined_apart(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.union(docs.where("doc_id < 5").withColumn("doc_id", F.col("doc_id") + 10_000)).union(docs.where("doc_id < 3").withColumn("doc_id", F.col("doc_id") + 20_000))
    whole = sorted(map(tuple, simhash.near_duplicates(docs).collect()))
    monkeypatch.setattr(simhash, "HOT", 1)
    assert sorted(map(tuple, simhash.near_duplicates(docs).collect())) == whole


def test_trees_keep_components_and_bound_degrees():
    label = np.array([0, 1, 0, 3, 1] + [5] * 5000)
    edges = simhash.trees(label)
    assert len(edges) == len(label) - 4 and (label[edges[:, 0]] == label[edges[:, 1]]).all()
    assert max(Counter(edges[:, 1].tolist()).values()) <= simhash.ARITY and len(set(edges[:, 0].tolist())) == len(edges)


def test_thresholds_of_nothing_probe_least():
    bits = np.zeros((0, 64), np.uint8)
    groups = simhash.bit_groups(bits, list(range(64)), 4)
    assert simhash.thresholds(bits, groups, 3, 0) == [0, 0, 0, 0]


# --- 9: top-k -------------------------------------------------------------------------------------------------


def plain_top(rows, k, every=20):
    """(query_id, score, vec_id) lists of every query row, by all pairs of whole numbers."""
    own = [(n, i, [math.floor(64 * x) for x in v]) for n, (i, v) in enumerate(rows) if i is not None and v and None not in v and np.isfinite(v).all()]
    out = defaultdict(list)
    for n, i, v in own:
        if i % every == 0:
            scores = sorted(((sum(a * b for a, b in zip(v, p)), j) for m, j, p in own if m != n), key=lambda s: (-s[0], s[1]))[:k]
            out[i] += [(rank + 1, score, j) for rank, (score, j) in enumerate(scores)]
    return {i: sorted(x) for i, x in out.items()}


def spark_top(spark, rows, **parameters):
    frame = spark.createDataFrame([(*r, "s") for r in rows], "vec_id long, embedding array<double>, score string")
    got = defaultdict(list)
    for r in topk.top_k(frame, **parameters).collect():
        got[r.query_id].append((r.rank, r.score, r.vec_id))
    return {i: sorted(x) for i, x in got.items()}


@pytest.mark.parametrize("parameters", [{}, {"block": 64, "group": 16, "cell_rows": 40}])
def test_topk_against_all_pairs(spark, parameters):
    rng = np.random.default_rng(9)
    centres = rng.normal(0, 0.4, (5, 12))
    x = [(i, [float(v) for v in centres[i % 5] + rng.normal(0, 0.1, 12)]) for i in range(700)]
    # repeated rows and ids, and what takes no part
    x += [(700 + i, x[3][1]) for i in range(150)] + [(40, x[0][1]), (40, x[1][1]), (40, x[1][1])]
    x += [(2000, None), (2020, []), (2040, [float("nan")] * 12), (2060, [None] * 12), (None, x[0][1])]
    assert spark_top(spark, x, k=10, **parameters) == plain_top(x, 10)


def test_topk_odd(spark):
    assert spark_top(spark, []) == {}
    few = [(0, [1.0, 2.0]), (20, [0.5, -1.0]), (3, [0.0, 0.0])]
    assert spark_top(spark, few) == plain_top(few, 20)


def test_topk_of_large_components_is_exact(spark):
    rng = np.random.default_rng(10)
    x = [(i, [float(v) * 10.0 ** (i % 7) for v in rng.normal(0, 1, 12)]) for i in range(120)] + [(1000, [3e6] * 12), (1001, [3e6 + 1] * 12), (1003, [0.015625] * 12)]
    assert spark_top(spark, x, k=10, block=16, group=4, cell_rows=10) == plain_top(x, 10)


def test_bounds_hold_and_trees_cover():
    rng = np.random.default_rng(11)
    x = rng.integers(-60, 60, (900, 8)).astype(float)
    todo = [topk.cover_tree(x, leaf=16)]
    assert sorted(todo[0].rows.tolist()) == list(range(900))
    q = x[:50]
    centre, radius = q.mean(axis=0), topk.distances(q, q.mean(axis=0)).max()
    while todo:
        node = todo.pop()
        assert topk.distances(x[node.rows], node.centre).max() <= node.radius
        assert (q @ x[node.rows].T).max() <= topk.most_possible(centre, radius, node.centre, node.radius)
        assert not node.children or sorted(np.concatenate([c.rows for c in node.children]).tolist()) == sorted(node.rows.tolist())
        todo += node.children


# --- 10: packing --------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.tokenizer_path())


def test_encoder_equals_the_library(library):
    enc = packing.WordEncoder(packing.tokenizer_path())
    texts = ["", "  ", "It's  we'LL don't 123 4a5 x_y ...!?", "a <|endoftext|> b", "Straße élan ÉÀ ñandú", "a\u00a0b\x1cc\x85d", "日本語 テスト 😀", "ΑΣ Σ İ ﬁ", "''s 'S 's's", "…“quoted”— dash", "e\u0301 caf\u0327e"]
    texts += [json.dumps({"k": [1, 2, {"x": None}]}), "https://m.example.org/?a=b&c=%20", "ABC" * 500]
    for t in texts:
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_packing_documents(spark, odd, none, library):
    rows = packing.packed_documents(odd).collect()
    ids = {(i, t): [*library.encode(t or "", add_special_tokens=False).ids, 0] for i, t, _, _ in ODD}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for (i, _), own in ids.items():
        for r in by_doc[i]:
            cut = own[r.start : r.start + r.length]
            assert r.start == 2048 * r.piece and zlib.crc32(np.array(cut, "<u4").tobytes()) == r.ids_crc32
    assert sum(r.length for r in rows) == sum(len(ids[i, t]) for i, t, _, _ in ODD)
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.packed_documents(none).collect() == []


def optimum(items, c):
    best, items = [len(items)], sorted(items, reverse=True)

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + items[i] <= c and bins[k] not in bins[:k]:
                bins[k] += items[i]
                go(i + 1, bins)
                bins[k] -= items[i]
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best[0]


def test_reduction_never_costs_a_sequence():
    rng = np.random.default_rng(10)
    for _ in range(150):
        c = int(rng.integers(10, 60))
        items = rng.integers(1, c + 1, int(rng.integers(1, 10))).tolist()
        slots, told = packing.plan(Counter(items), c)
        assert sum(s * n for s, _, n, _, _ in slots.tolist()) == sum(items)
        rest = [s for s, _, n, q, _ in slots.tolist() for i in range(n) if q + i >= told["fixed_by_reduction"]]
        assert told["fixed_by_reduction"] + (optimum(rest, c) if rest else 0) == optimum(items, c)


# --- the pipeline -------------------------------------------------------------------------------------------


def test_pipeline_against_plain_stages(spark, none, library):
    """Each stage's decisions made again one document at a time, the pairs of near copies by all pairs."""
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "toxicity", "simhash_near_dedup", "mixing", "best_fit_packing"]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).collect() == []
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(langid.labelled_sample(docs))
    spoken = []
    for r in docs.collect():
        (lang,), (score,) = langid.predict(model, [r.text or ""])
        if lang != "und" and score >= 1 / len(model.languages) + langid.LEAST_LEAD:
            spoken.append(r)
    left = docs.where(F.col("doc_id").isin([r.doc_id for r in spoken]))
    chain = toxicity.fitted(left, spark.read.parquet(f"{SF}/labels.parquet"))
    clean = [r for r in spoken if toxicity.probabilities(chain, [r.text])[0, -1] < toxicity.THRESHOLD]
    kept = set(brute_groups([(r.doc_id, r.text) for r in clean]))
    con = connect(SF)
    rows = [r for r in clean if r.doc_id in kept]
    con.execute("CREATE OR REPLACE TEMP TABLE kept (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO kept VALUES (?, ?, ?)", [(r.doc_id, r.text, r.source) for r in rows])
    cur = con.execute(re.sub(r"\bdocuments\b", "kept", mixing.OP2_SQL))
    names = [c[0] for c in cur.description]
    taken = {r[names.index("doc_id")]: (r[names.index("taken")], r[names.index("size")]) for r in cur.fetchall()}
    text = {r.doc_id: r.text for r in rows}
    want, tokens = Counter(), 0
    for i, (t, size) in taken.items():
        copies = -(-t // size) if size else 0
        n = len(library.encode(text[i], add_special_tokens=False).ids) + 1
        want[i] += copies * -(-n // 2048)
        tokens += copies * n
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter(r.doc_id for r in got) == +want and sum(r.length for r in got) == tokens
    held = defaultdict(int)
    for r in got:
        held[r.sequence_id] += r.length
    assert max(held.values()) <= 2048 and len(held) <= -(-tokens // 2048) * 1.02 + 1


def test_rows_survive_the_filters(spark, odd):
    """Clean documents stay as they are, extra columns included."""
    for stage in (toxicity.stage_toxicity, langid.stage_langid, simhash.stage_simhash):
        out = stage(spark, odd, SF)
        assert out.columns == odd.columns and isinstance(out.first(), Row)
