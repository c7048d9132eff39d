"""Best-fit packing after a Martello-Toth dominance reduction.

Documents become token ids by a public tokenizer, each followed by one end id. Documents longer than a
sequence are cut into full pieces and a last piece. Only lengths matter to the packing, and lengths are
bounded by the sequence length, so the plan is made on the histogram of lengths (at most 2048 entries,
whatever the number of documents):

* reduction: while the largest remaining length has a set of companions that dominates every other
  feasible set, that sequence is fixed, as many times as the counts allow;
* best fit, decreasing, on the rest: runs of equal lengths go into runs of equally filled sequences.

A plan is a list of slots (length, first rank, count, first sequence, offset). Documents get a rank among
the pieces of their length by a distributed prefix count, and look up their slot in the broadcast plan.

Defined cases: a null text is empty, one end id long; a null doc_id is packed like any other; rows that
repeat a doc_id are packed each; a very long text is encoded whole, its words a megabyte at a time, and cut into as
many pieces as it needs; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, table, text_chunks, text_slices

SEQUENCE = 2048
END_ID = 0
TOKENIZER = "word_bpe_49k.json"
#: Words whose ids a worker remembers, and how long they may be: some 170 MB.
REMEMBERED = 800_000
REMEMBERED_LENGTH = 48
#: Chunks that a length's rows are ranked in, at least, and rows a chunk should hold at most.
LEAST_CHUNKS = 256
CHUNK_ROWS = 1_000_000


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Token ids of whole texts, equal to the tokenizer library's.

    A text of this vocabulary is a sequence of pretokens that are encoded one by one, so their ids are
    remembered. Texts with what crosses pretokens or has its own rules (special tokens' strings, control
    characters, letters outside Latin, combining marks) are left to the library as a whole.
    """

    #: Beyond Latin-1, what the piecewise way isn't meant for.
    UNUSUAL = re.compile("[\u0130\u0149\u01f0\u0250-\u1fff\u2000-\U0010ffff]")
    CONTROLS = bytes([*range(9), *range(0x0B, 0x0D), *range(0x0E, 0x20), *range(0x7F, 0xA0)])

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.whole = Tokenizer.from_file(path)
        self.pretokens = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.model = self.whole.model
        self.letters = byte_letters()
        self.remembered = remembered
        self.known: dict[str, bytes] = {}
        self.specials = [t["content"] for t in spec["added_tokens"]]

    def pretoken(self, piece: str) -> list[int]:
        return [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))]

    def chunk(self, word: str) -> bytes:
        """Little-endian 32-bit ids of what stands between white space."""
        if word.isalpha() and word.isascii():
            # letters that stand for themselves at the byte level
            return array("I", [t.id for t in self.model.tokenize(word.lower())]).tobytes()
        ids: list[int] = []
        for piece in self.pretokens.findall(unicodedata.normalize("NFC", word).lower()):
            ids += self.pretoken(piece)
        return array("I", ids).tobytes()

    def usual(self, text: str) -> bool:
        try:
            plain = text.encode("latin-1")
        except UnicodeEncodeError:
            if self.UNUSUAL.search(text):
                return False
            plain = text.encode("latin-1", "replace")
        return len(plain.translate(None, self.CONTROLS)) == len(plain) and not any(s in text for s in self.specials)

    def encode(self, text: str) -> bytes:
        if not self.usual(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join([self.words(part.split()) for part in text_chunks(text)])

    def words(self, words: list[str]) -> bytes:
        """The ids of words in a row. What is remembered is bounded in number and length."""
        known = self.known
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            pass
        if len(known) > self.remembered:
            known.clear()
        long = {}
        for w in words:
            if w not in known:
                (known if len(w) <= REMEMBERED_LENGTH else long)[w] = self.chunk(w)
        return b"".join([known[w] for w in words] if not long else [known[w] if w in known else long[w] for w in words])


def byte_letters() -> dict[int, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for letters from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (b for b in range(256) if b not in set(own))
    return {b: b for b in own} | {b: 0x100 + k for k, b in enumerate(rest)}


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each Python worker; what it remembers serves all its tasks."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, path: str | None = None, most: int = SEQUENCE, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 for every piece of every document."""
    path = path or tokenizer_path()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for part in text_slices(batch, "text"):
                out: list[tuple] = []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1)):
                    ids = enc.encode(text.as_py() or "") + end
                    for k, at in enumerate(range(0, len(ids), 4 * most)):
                        cut = ids[at : at + 4 * most]
                        out.append((doc, k, at // 4, len(cut) // 4, zlib.crc32(cut)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


# --- the plan, on the histogram of lengths ---------------------------------------------------------


class Supply:
    """What is left of each length, with the lengths in ascending order."""

    def __init__(self, histogram: dict[int, int]):
        self.left = {s: n for s, n in histogram.items() if n > 0}
        self.sizes = sorted(self.left)
        self.given = dict.fromkeys(histogram, 0)

    def at_most(self, size: int, without: tuple[int, ...] = ()) -> int | None:
        """The largest length up to `size` of which more is left than `without` uses."""
        i = bisect_left(self.sizes, size + 1) - 1
        while i >= 0:
            s = self.sizes[i]
            if self.left[s] > without.count(s):
                return s
            i -= 1
        return None

    def smallest(self, n: int, without: tuple[int, ...]) -> list[int]:
        out: list[int] = []
        for s in self.sizes:
            out += [s] * min(n - len(out), self.left[s] - without.count(s))
            if len(out) == n:
                break
        return out

    def take(self, size: int, count: int) -> int:
        """Take `count` pieces; returns the first one's rank among its length."""
        rank = self.given[size]
        self.given[size] += count
        self.left[size] -= count
        if not self.left[size]:
            del self.left[size]
            self.sizes.pop(bisect_left(self.sizes, size))
        return rank


def dominating(supply: Supply, capacity: int, size: int) -> tuple[int, ...] | None:
    """The companions of a remaining length in a set that dominates all other feasible sets with it, or None if none is
    proven to. It holds for any length, whatever longer ones remain: another set's companions can be swapped against these."""
    room = capacity - size
    best = supply.at_most(room, (size,))
    if best is None:
        return ()
    if best == room:  # an exact fill by one piece: any other companions could be swapped against it
        return (best,)
    low = supply.smallest(3, (size,))
    if len(low) < 2 or low[0] + low[1] > room:  # one companion at most: the largest one
        return (best,)
    if len(low) < 3 or sum(low) > room:  # two companions at most
        for a in supply.sizes:
            if a > room:
                break
            b = supply.at_most(min(room - a, a), (size, a))
            if b is not None and a + b > best:
                break
        else:
            a = room + 1
        if a > room:  # every feasible pair fits in the place of the one piece
            return (best,)
        first = supply.at_most(room - low[0], (size,))
        second = supply.at_most(room - first, (size, first)) if first is not None else None
        if second is not None and first == best and second == low[0]:
            # the largest companion of all together with the only length that can join any
            others = supply.at_most(room - low[0], (size, low[0]))
            if supply.at_most(room // 2, (size, low[0])) is None and others == first:
                return (first, second)
    return None


class Plan:
    """Slots (length, first rank, count, first sequence, offset) as they are filled."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.supply, self.capacity = Supply(histogram), capacity
        self.slots: list[tuple[int, int, int, int, int]] = []
        self.sequences = 0

    def fix(self, size: int) -> bool:
        """Fill sequences with a length and what dominates with it, as often as there is enough of both."""
        mates = dominating(self.supply, self.capacity, size)
        if mates is None:
            return False
        parts, offset = (size, *mates), 0
        times = min(self.supply.left[s] // parts.count(s) for s in parts)
        for s in dict.fromkeys(parts):
            for _ in range(parts.count(s)):
                self.slots.append((s, self.supply.take(s, times), times, self.sequences, offset))
                offset += s
        self.sequences += times
        return True

    def reduce(self) -> None:
        """Fix sets of any length, the longest first, until no length has one. What is fixed leaves fewer companions for the
        others, so lengths are tried again."""
        moved = True
        while moved:
            moved = False
            for size in reversed(list(self.supply.sizes)):
                while self.supply.left.get(size) and self.fix(size):
                    moved = True

    def reduce_longest(self) -> None:
        """Fix sets of the longest length only, up to the first one without."""
        while self.supply.sizes and self.fix(self.supply.sizes[-1]):
            pass

    def best_fit(self) -> None:
        """Best fit, decreasing: groups of equally filled sequences by their room."""
        supply, slots, capacity = self.supply, self.slots, self.capacity
        rooms: dict[int, list[tuple[int, int]]] = {}
        order: list[int] = []

        def put(room: int, first: int, count: int) -> None:
            if room not in rooms:
                rooms[room] = []
                insort(order, room)
            rooms[room].append((first, count))

        while supply.sizes:
            size = supply.sizes[-1]
            count = supply.left[size]
            at = bisect_left(order, size)
            if at == len(order):
                fit = capacity // size
                opened = (count + fit - 1) // fit
                first, self.sequences = self.sequences, self.sequences + opened
                put(capacity, first, opened)
                continue
            room = order[at]
            first, held = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
                order.pop(at)
            # best fit fills a sequence with this length as long as it fits before it takes the next one
            fit = room // size
            full, rest = divmod(count, fit)
            full = min(full, held)
            if full:
                for k in range(fit):
                    slots.append((size, supply.take(size, full), full, first, capacity - room + k * size))
                if room - fit * size:
                    put(room - fit * size, first, full)
                first, held = first + full, held - full
                if held:
                    put(room, first, held)
            else:
                slots += [(size, supply.take(size, 1), 1, first, capacity - room + k * size) for k in range(rest)]
                if room - rest * size:
                    put(room - rest * size, first, 1)
                if held > 1:
                    put(room, first + 1, held - 1)


def plan(histogram: dict[int, int], capacity: int = SEQUENCE) -> tuple[np.ndarray, dict[str, int]]:
    """Slots (length, first rank, count, first sequence, offset) and what the plan came to. The reduction keeps an optimum,
    but best fit may do worse on what it leaves than on more; so where the bound isn't reached a reduction that stops at
    the first longest length without a dominating set is tried too, and the shorter plan counts."""
    at_least = -(-sum(s * n for s, n in histogram.items()) // capacity)
    best, fixed = None, 0
    for reduction in (Plan.reduce, Plan.reduce_longest):
        made = Plan(histogram, capacity)
        reduction(made)
        reduced = made.sequences
        made.best_fit()
        if best is None or made.sequences < best.sequences:
            best, fixed = made, reduced
        if best.sequences == at_least:
            break
    told = {"sequences": best.sequences, "fixed_by_reduction": fixed, "at_least": at_least}
    return np.array(sorted(best.slots), np.int64).reshape(-1, 5), told


def ranked(sized: DataFrame, chunks: int) -> DataFrame:
    """Adds `rank`, from 0, among the rows of equal length. Lengths are split by hash into chunks, so a
    length that holds a third of all rows is ranked by many tasks; chunk counts give each chunk's start."""
    keyed = sized.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(chunks)).cast("int"))
    counts = keyed.groupBy("length", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("length").alias("cl"), F.col("chunk").alias("cc"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begins"))
    within = Window.partitionBy("length", "chunk").orderBy("doc_id", "piece", "ids_crc32")
    placed = keyed.withColumn("within", F.row_number().over(within) - 1)
    joined = placed.join(starts, (F.col("length") == F.col("cl")) & (F.col("chunk") == F.col("cc")))
    return joined.select(*sized.columns, (F.col("begins") + F.col("within")).cast("long").alias("rank"))


def pack(cut: DataFrame, capacity: int = SEQUENCE) -> DataFrame:
    """Pieces with a `length` -> the same with sequence_id and offset."""
    histogram = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    slots, _ = plan(histogram, capacity)
    # one sorted key for (length, rank): the last slot that begins at or before it
    span = max([1, *histogram.values()]) + 1
    begins = slots[:, 0] * span + slots[:, 1]
    shared = cut.sparkSession.sparkContext.broadcast((begins, slots))
    names = cut.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins, slots = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            length = batch.column(names.index("length")).to_numpy()
            rank = batch.column(len(names)).to_numpy()
            slot = slots[np.searchsorted(begins, length * span + rank, side="right") - 1]
            kept = [batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(slot[:, 3] + rank - slot[:, 1]), pa.array(slot[:, 4])], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema.fields) + ", sequence_id long, offset long"
    # enough chunks that none of the commonest length's holds much over CHUNK_ROWS
    chunks = max(LEAST_CHUNKS, max([0, *histogram.values()]) // CHUNK_ROWS)
    return ranked(cut, chunks).mapInArrow(run, schema)


def packed_documents(docs: DataFrame, path: str | None = None, capacity: int = SEQUENCE) -> DataFrame:
    return pack(materialize(pieces(docs, path, capacity)), capacity)


def op10_packing(spark, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"))


def stage_pack(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document it is given, packed, null texts and repeated rows among them; what it returns
    are the pieces and their places."""
    return packed_documents(docs)
