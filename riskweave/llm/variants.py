"""Spelling variants: words one edit apart, found through forward and reversed dictionaries.

Of two words that differ by one inserted, deleted or replaced code point, one half of the shorter stays intact: they
share its beginning, or else its end. Every word therefore stands in two dictionaries, by its beginning and by its
reversed end, once as the shorter and once as the longer word of a pair. The dictionaries are sorted, so the words
that share a half lie together and a block is scanned as a range. What is left of the words of a block differs by one
edit too, so a large block is divided in the same way by the halves of the rest, and again until it is small: blocks
over `SPLIT` words between tasks, the others inside one. Pairs in small blocks are verified; each pair is met in one
block only, because the block of a shared end takes no pair that shares the beginning. A word keeps the number of its
near words and the best one; pairs are never written.

Words that are counted pass a fixed mutation first, which makes variants: see `word_counts`.

Defined cases: a null text has no words; a null doc_id counts as the empty text; rows that repeat each count; words of
equal n tie to the smallest in code-point order; very long texts are counted a piece at a time; a very long word is
compared like any other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, plain_planning, table, text_chunks

LEAST_LENGTH, LEAST_COUNT = 5, 3
#: A word changes by its document where this divides the checksum.
MUTATION = 97
#: How many times as frequent a word's form is.
FORM_RATIO = 2
#: Words of a block that one task takes; larger ones are divided between tasks.
SPLIT = 2048
#: Words of a block whose pairs are all verified.
DIRECT = 8
_RUN = re.compile(f"[a-zÀ-ÿ]{{{LEAST_LENGTH},}}")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Counted or linked words that a task holds before it passes them on.
HELD = 200_000
_FAR = 1 << 30
NEAR = "word string, n_near long, n long, near string"


def counted(doc_id: str, text: str) -> Counter:
    """The words of one document. A run whose checksum with the document's id is a multiple of `MUTATION` loses a code
    point."""
    begin = zlib.crc32(f"{doc_id}:".encode())
    out: Counter = Counter()
    for piece in text_chunks(text):
        lower = piece.encode("utf-8", "surrogatepass").translate(_LOWER).decode("utf-8", "surrogatepass")
        for run, k in Counter(_RUN.findall(lower)).items():
            h = zlib.crc32(run.encode(), begin)
            if h % MUTATION == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
                if len(run) < LEAST_LENGTH:
                    continue
            out[run] += k
    return out


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n: all words of enough code points and occurrences."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                if text.is_valid:
                    held.update(counted(doc_id.as_py(), text.as_py()))
                    if len(held) >= HELD:
                        yield flush()
                        held.clear()
        if held:
            yield flush()

    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text")
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _divided(rows: DataFrame) -> DataFrame:
    """Each word of a block in the blocks of both halves of its rest. A block: `short`, the length of its shorter words;
    `lo` and `hi`, the code points shared at the beginning and the end; `below`, what a pair's shared beginning must be
    less than, as longer ones are met elsewhere."""
    k = F.floor((F.col("short") - F.col("lo") - F.col("hi")) / 2).cast("int")
    half = lambda lo, hi, below: F.struct(F.col("short"), lo.cast("int").alias("lo"), hi.cast("int").alias("hi"), below.cast("int").alias("below"))
    ahead = half(F.col("lo") + k, F.col("hi"), F.col("below"))
    behind = half(F.col("lo"), F.col("short") - F.col("lo") - k, F.least(F.col("below"), F.col("lo") + k))
    return rows.select("word", "n", F.explode(F.array(ahead, behind)).alias("b")).select("word", "n", "b.*").withColumn("block", _block())


def _block() -> Column:
    """What the words of a block share, the end reversed, and how."""
    end = F.reverse(F.right("word", F.col("hi")))
    return F.concat_ws("\u0001", "short", "lo", "hi", "below", F.substring("word", F.lit(1), F.col("lo")), end)


def dictionaries(words: DataFrame, split: int = SPLIT) -> DataFrame:
    """The words in blocks of at most `split` words, but for those that can't be divided further: these differ in one
    code point, or two, and so are bounded by the alphabet."""
    length = F.length("word")
    shorter = F.explode(F.when(length > LEAST_LENGTH, F.array(length, length - 1)).otherwise(F.array(length))).alias("short")
    whole = words.select("word", "n", shorter, F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.lit(_FAR).alias("below"))
    rows, done = materialize(_divided(whole)), []
    while True:
        big = rows.where(F.col("short") - F.col("lo") - F.col("hi") > 1).groupBy("block").count().where(F.col("count") > split).select("block")
        big = materialize(big)
        if big.isEmpty():
            done.append(rows)
            break
        done.append(rows.join(big, "block", "left_anti"))
        rows = materialize(_divided(rows.join(big, "block", "left_semi")))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def common_start(a: str, b: str, at: int) -> int:
    """How many code points `a` and `b` share at the beginning, of which `at` are known."""
    most = min(len(a), len(b))
    step = 64
    while at + step <= most and a[at : at + step] == b[at : at + step]:  # for very long words
        at += step
    while at < most and a[at] == b[at]:
        at += 1
    return at


def one_edit(a: str, b: str, lo: int, below: int) -> bool:
    """Whether the words, which share `lo` code points at the beginning, are one edit apart and share less than `below`."""
    if len(a) > len(b):
        a, b = b, a
    at = common_start(a, b, lo)
    return at < below and a != b and a[at + (len(a) == len(b)) :] == b[at + 1 :]


def scan(block: list[tuple[str, int]], short: int, lo: int, hi: int, below: int, link: Callable) -> None:
    """Link all pairs of a block that are one edit apart, the shorter word of `short` code points."""
    first = [e for e in block if len(e[0]) == short]
    if not first or len(block) < 2:
        return
    rest = [e for e in block if len(e[0]) > short]
    free = short - lo - hi
    if len(block) <= DIRECT:
        for k, a in enumerate(first):
            for b in (*first[k + 1 :], *rest):
                if one_edit(a[0], b[0], lo, below):
                    link(a, b)
    elif free <= 1:  # one code point is left of the shorter words, two of the longer: look up the longer ones
        for k, a in enumerate(first):
            for b in first[k + 1 :]:
                if one_edit(a[0], b[0], lo, below):
                    link(a, b)
        by_rest = {a[0][lo : lo + free]: a for a in first}
        for b in rest:
            for left in {b[0][lo : lo + free], b[0][lo + 1 : lo + 1 + free]}:
                if left in by_rest and one_edit(by_rest[left][0], b[0], lo, below):
                    link(by_rest[left], b)
    else:
        k = free // 2
        end = hi + free - k
        ahead, behind = defaultdict(list), defaultdict(list)
        for e in block:
            ahead[e[0][lo : lo + k]].append(e)
            behind[e[0][len(e[0]) - end : len(e[0]) - hi]].append(e)
        for part in ahead.values():
            scan(part, short, lo + k, hi, below, link)
        for part in behind.values():
            scan(part, short, lo, end, min(below, lo + k), link)


def near_words(words: DataFrame, split: int = SPLIT) -> DataFrame:
    """word, n_near, and n and near: the near word of largest n."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list] = {}

        def link(a: tuple[str, int], b: tuple[str, int]) -> None:
            for (word, _), (near, n) in ((a, b), (b, a)):
                best = found.setdefault(word, [0, 0, ""])
                best[0] += 1
                if n > best[1] or n == best[1] and near < best[2]:
                    best[1:] = n, near

        def flush() -> pa.RecordBatch:
            columns = [list(found), *(list(c) for c in zip(*found.values()))]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["word", "n_near", "n", "near"])

        key, shape, block = None, None, []
        for batch in batches:
            for name, word, n, *at in zip(*(c.to_pylist() for c in batch.columns)):
                if name != key:
                    if len(block) > 1:
                        scan(block, *shape, link)
                    key, shape, block = name, at, []
                    if len(found) >= HELD:
                        yield flush()
                        found.clear()
                block.append((word, n))
        if len(block) > 1:
            scan(block, *shape, link)
        if found:
            yield flush()

    rows = dictionaries(words, split).select("block", "word", "n", "short", "lo", "hi", "below")
    best = F.min(F.struct((-F.col("n")).alias("less"), F.col("near").alias("near")))
    return (
        rows.repartition("block")
        .sortWithinPartitions("block")
        .mapInArrow(run, NEAR)
        .groupBy("word")
        .agg(F.sum("n_near").alias("n_near"), best.alias("best"))
        .select("word", "n_near", (-F.col("best.less")).alias("n"), "best.near")
    )


def spelling_variants(docs: DataFrame, split: int = SPLIT) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word."""
    with plain_planning(docs.sparkSession):
        words = materialize(word_counts(docs))
        near = near_words(words, split).select("word", "n_near", F.col("n").alias("m"), "near")
        is_form = F.col("m") >= FORM_RATIO * F.col("n")
        forms = materialize(
            words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("m")).alias("form_n"))
        )
        # n doubles with each step, so pointers end; each round doubles how far they reach.
        roots = materialize(forms.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
        while True:
            ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
            moved = roots.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
            moved = materialize(moved)
            roots = moved.select("word", "root")
            if moved.where("moved").isEmpty():
                break
    return forms.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_variants(spark, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


#: Near words through the strings that one deletion leaves, each with its place for a replaced code point. The list of
#: sixteen is CRC-32's table for four bits, a fixed value.
OP11_SQL = r"""
WITH RECURSIVE t AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
    unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run
  FROM documents
), r AS (
  SELECT id, run, count(*) AS k FROM t WHERE length(run) >= 5 GROUP BY ALL
), c AS (
  SELECT run, k, 4294967295::UBIGINT - list_reduce(
    list_prepend(4294967295::UBIGINT, flatten(list_transform(range(1, 2 * strlen(id || ':' || run) + 1, 2),
      lambda x: [strpos('0123456789ABCDEF', hex(id || ':' || run)[x + 1])::UBIGINT - 1, strpos('0123456789ABCDEF', hex(id || ':' || run)[x])::UBIGINT - 1]))),
    lambda crc, x: xor(crc >> 4, ([0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948,
      3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]::UBIGINT[])[(xor(crc, x) & 15)::BIGINT + 1])) AS h
  FROM r
), m AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, k FROM c
), w AS (
  SELECT word, CAST(sum(k) AS BIGINT) AS n FROM m WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3
), x AS (
  SELECT word, unnest(range(1, length(word) + 1)) AS p FROM w
), d AS (
  SELECT word, p, substr(word, 1, p - 1) || substr(word, p + 1) AS s FROM x
), near AS (
  SELECT a.word, b.word AS other FROM d a JOIN d b ON a.s = b.s AND a.p = b.p AND a.word <> b.word AND length(a.word) = length(b.word)
  UNION
  SELECT d.word, w.word FROM d JOIN w ON w.word = d.s
  UNION
  SELECT w.word, d.word FROM d JOIN w ON w.word = d.s
), g AS (
  SELECT near.word, count(*) AS n_near, min(struct_pack(less := -o.n, word := o.word)) AS best FROM near JOIN w o ON o.word = near.other GROUP BY near.word
), f AS (
  SELECT w.word, w.n, coalesce(g.n_near, 0) AS n_near, CASE WHEN -g.best.less >= 2 * w.n THEN g.best.word END AS form, CASE WHEN -g.best.less >= 2 * w.n THEN -g.best.less END AS form_n
  FROM w LEFT JOIN g ON g.word = w.word
), u AS (
  SELECT word, word AS root FROM f
  UNION ALL
  SELECT u.word, f.form FROM u JOIN f ON f.word = u.root WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, u.root, f.n, f.n_near, CAST(f.form_n AS BIGINT) AS form_n
FROM f JOIN u ON u.word = f.word JOIN f e ON e.word = u.root AND e.form IS NULL
"""
