"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints that differ in at most `radius` bits are linked. Candidate search works on distinct
fingerprints only, so a group of any number of copies is one entry:

1. Bits are grouped into partitions by their correlation, measured on a bounded sample of fingerprints.
2. A partition gets its own threshold, -1 (not probed) or more, with sum(t + 1) = radius + 1: two
   fingerprints within the radius must be within t bits on some partition with threshold t. A dynamic
   program picks the thresholds with the least estimated number of candidates and probes.
3. Each fingerprint enters its own value in the index of every probed partition, and probes all values
   within the partition's threshold. Values that hold many fingerprints are partitioned again on the
   remaining bits, with thresholds of their own from the same dynamic program.
4. Candidates that share a value are verified, block by block, but for blocks that are connected already. A
   bucket yields a tree of bounded degree for each component, not pairs.
5. Components are found by repeated contraction of that edge table (hooking in random order, pointer jumps).

Defined cases: a null text is empty; a text without words has fingerprint zero, linked like any other;
rows that repeat a doc_id are each returned; a null doc_id takes part, but is never a component's name
unless all its documents lack an id; very long texts are hashed whole; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, plain_planning, table, text_chunks, text_slices

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Distinct fingerprints on which correlations and candidate counts are estimated.
SAMPLE = 2048
#: Characters of a text whose words are held at once.
LONG = 1 << 21
#: Bytes of texts whose shingles are hashed together.
TOGETHER = 1 << 19
#: A bucket above this is partitioned again on its remaining bits.
LARGE_BUCKET = 512
#: Buckets up to this are compared together.
SMALL_BUCKET = 128
#: Children of a node in the trees that stand for components, so that no node is the end of very many edges.
ARITY = 64
#: A fingerprint or root with more rows than this is joined apart or spread over `WAYS` tasks.
HOT = 100_000
WAYS = 16
#: The constants of XXH64.
_XXH = [np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]
#: A-Z as lower-case letters, white space as spaces.
_PLAIN = bytes(32 if 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in range(256))


def word_runs(text: str | None, width: int) -> Iterator[list[bytes]]:
    """A text's lower-cased words; those of a long text in runs, each of which begins with the last `width` - 1 words of
    the one before, so that every shingle is in one run."""
    held: list[bytes] = []
    enough = False
    for part in text_chunks(text or "", LONG):
        words = held + part.encode("utf-8", "surrogatepass").lower().split()
        if len(words) >= width:
            enough = True
            yield words
            held = words[len(words) - width + 1 :]
        else:
            held = words
    if held and not enough:
        yield held


def run_hashes(words: list[bytes], width: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of each shingle of a run; of fewer words, of them all."""
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1])).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist())], np.uint64)


def fingerprint(text: str | None, width: int = SHINGLE, seed: int = SEED) -> int:
    """The SimHash of one text: bit i is set if it is set in over half of the shingles' XXH64."""
    counts, total = np.zeros(64, np.int64), 0
    for words in word_runs(text, width):
        hashes = run_hashes(words, width, seed)
        counts += bit_counts(hashes)
        total += len(hashes)
    return int.from_bytes(np.packbits(2 * counts > total).tobytes(), "big")


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """In how many hashes each bit is set, the highest bit first; blocks bound the memory."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        block = hashes[at : at + (1 << 14)].astype(">u8")
        counts += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return counts


def plain_words(text: str) -> bytes:
    """A text's lower-cased words, one space between them."""
    plain = text.encode("utf-8", "surrogatepass").translate(_PLAIN)
    return b" ".join(plain.split()) if b"  " in plain else plain.strip(b" ")


def rotated(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def piece_hashes(data: bytes, starts: np.ndarray, lengths: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of the pieces of `data` that begin at `starts`; eight bytes follow the last one. Pieces of one length are hashed
    together, those of 32 bytes or more, which are few among shingles, one by one."""
    words = np.ndarray(len(data) - 7, "<u8", data, strides=(1,)).astype(np.uint64)
    out = np.empty(len(starts), np.uint64)
    order = np.argsort(np.minimum(lengths, 32).astype(np.uint8), kind="stable")
    bounds = np.searchsorted(lengths[order], np.arange(33)).tolist()
    for i in order[bounds[32] :].tolist():
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : starts[i] + lengths[i]], seed)
    for n in range(32):
        rows = order[bounds[n] : bounds[n + 1]]
        if not len(rows):
            continue
        at = starts[rows]
        h = np.full(len(rows), (seed + int(_XXH[4]) + n) % (1 << 64), np.uint64)
        for _ in range(n // 8):
            h = rotated(h ^ rotated(words[at] * _XXH[1], 31) * _XXH[0], 27) * _XXH[0] + _XXH[3]
            at = at + 8
        rest = words[at]
        if n & 4:
            h = rotated(h ^ (rest & np.uint64(0xFFFFFFFF)) * _XXH[0], 23) * _XXH[1] + _XXH[2]
            rest = rest >> np.uint64(32)
        for _ in range(n & 3):
            h = rotated(h ^ (rest & np.uint64(0xFF)) * _XXH[4], 11) * _XXH[0]
            rest = rest >> np.uint64(8)
        h = (h ^ (h >> np.uint64(33))) * _XXH[1]
        h = (h ^ (h >> np.uint64(29))) * _XXH[2]
        out[rows] = h ^ (h >> np.uint64(32))
    return out


def set_bits(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How often each bit, the lowest first, is set in each run of `hashes`; `first` has the runs' places. The bytes of a word
    count a bit of up to 255 hashes each."""
    place = np.arange(len(hashes)) - np.repeat(first, np.diff(np.append(first, len(hashes))))
    parts = np.flatnonzero(place % 255 == 0)
    ones = np.uint64(0x0101010101010101)
    sums = [np.add.reduceat((hashes >> np.uint64(j)) & ones, parts).astype("<u8").view(np.uint8).reshape(-1, 8) for j in range(8)]
    return np.add.reduceat(np.stack(sums, axis=2).reshape(-1, 64).astype(np.int64), np.searchsorted(parts, first), axis=0)


def many_fingerprints(texts: list[str | None], width: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """fingerprint() of each text, their shingles hashed together."""
    out = np.zeros(len(texts), np.uint64)
    which, plain = [], []
    for k, text in enumerate(texts):
        if text and len(text) > LONG:
            out[k] = fingerprint(text, width, seed)
        elif text and (words := plain_words(text)):
            which.append(k)
            plain.append(words)
    if not plain:
        return out
    data = b" ".join(plain) + b" " * 8
    # a word ends at each space, up to the last text's
    size = np.cumsum(np.fromiter(map(len, plain), np.int64, len(plain)) + 1)
    ends = np.flatnonzero(np.frombuffer(data, np.uint8, int(size[-1])) == 32)
    starts = np.append(0, ends[:-1] + 1)
    after = np.searchsorted(ends, size)  # the first word after each text
    count = np.diff(np.append(0, after))
    word = np.arange(len(ends))
    last = np.minimum(word + width, np.repeat(after, count)) - 1
    # a text has a shingle at each word that `width` words begin at, or at its first
    heads = (word + width <= np.repeat(after, count)) | (word == np.repeat(after - count, count))
    hashes = piece_hashes(data, starts[heads], (ends[last] - starts)[heads], seed)
    shingles = np.maximum(1, count - width + 1)
    bits = 2 * set_bits(hashes, np.cumsum(shingles) - shingles) > shingles[:, None]
    out[which] = np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) for every row."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text", TOGETHER):
                fps = many_fingerprints(part.column(1).to_pylist(), width).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps)], ["doc_id", "fp"])

    return narrow.mapInArrow(run, "doc_id long, fp long")


# --- partitions and thresholds -------------------------------------------------------------------


def to_bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.astype(np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)[:, ::-1]


def bit_groups(bits: np.ndarray, free: list[int], parts: int) -> list[list[int]]:
    """Group `free` bits into `parts` partitions of near-equal size, each grown from its seed by the bit
    most correlated with it, so that correlated bits meet and partitions are as independent as can be."""
    x = bits[:, free].astype(np.float64)
    if len(x):
        x -= x.mean(axis=0)
    norm = np.sqrt((x * x).sum(axis=0))
    norm[norm == 0] = 1
    corr = np.abs((x / norm).T @ (x / norm))
    left, groups = list(range(len(free))), []
    for k in range(parts):
        size = len(left) // (parts - k)
        # the seed with the strongest ties first
        seed = max(left, key=lambda i: (corr[i, left].sum(), -i))
        group = [seed]
        left.remove(seed)
        while len(group) < size:
            best = max(left, key=lambda i: (corr[i, group].mean(), -i))
            group.append(best)
            left.remove(best)
        groups.append(sorted(free[i] for i in group))
    return groups


def ball(width: int, t: int) -> int:
    """How many values lie within t bits of a value of `width` bits; 0 for t = -1."""
    total, term = 0, 1
    for k in range(t + 1):
        total += term
        term = term * (width - k) // (k + 1)
    return total


def thresholds(bits: np.ndarray, groups: list[list[int]], radius: int, rows: int, probe_cost: float = 4.0) -> list[int]:
    """One threshold a partition with sum(t + 1) = radius + 1, of least estimated cost: candidate pairs
    extrapolated from the sample's distance histogram, and rows emitted for probes."""
    n = len(bits)
    cost = []
    for group in groups:
        x = bits[:, group].astype(np.float32)
        ones = x.sum(axis=1)
        dist = np.rint(ones[:, None] + ones[None, :] - 2 * (x @ x.T)).astype(np.int64) if n else np.zeros((0, 0), np.int64)
        near = np.bincount(dist[np.triu_indices(n, 1)], minlength=len(group) + 1) if n > 1 else np.zeros(len(group) + 1)
        pairs = max(1, n * (n - 1) // 2)
        # a floor for values too rare to meet in the sample: uniform bits
        of = lambda t: max(near[: t + 1].sum() / pairs, ball(len(group), t) / 2.0 ** len(group))
        cost.append([0.0] + [of(t) * rows * rows / 2 + probe_cost * rows * ball(len(group), t) for t in range(radius + 1)])
    # of equal costs the one with the fewest probes
    best: dict[int, tuple[float, int, list[int]]] = {0: (0.0, 0, [])}
    for row, group in zip(cost, groups):
        step: dict[int, tuple[float, int, list[int]]] = {}
        for used, (c, probes, picks) in best.items():
            for t in range(-1, radius + 1 - used):
                key, now = used + t + 1, (c + row[t + 1], probes + ball(len(group), t))
                if key not in step or now < step[key][:2]:
                    step[key] = (*now, [*picks, t])
        best = step
    return best[radius + 1][2]


def masks(groups: list[list[int]], ts: list[int]) -> list[tuple[int, list[int]]]:
    """(partition's mask, xor masks of its probes) for each probed partition."""
    out = []
    for group, t in zip(groups, ts):
        if t >= 0:
            flips = [sum(1 << b for b in c) for k in range(t + 1) for c in combinations(group, k)]
            out.append((sum(1 << b for b in group), flips))
    return out


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


# --- candidates, verification, components --------------------------------------------------------


def _entries(fps: DataFrame, plan: list[tuple[int, list[int]]]) -> DataFrame:
    """fp, path... -> (part, value, fp, probe): own values (probe false) and neighbouring values (probe true)."""
    def values(k: int, mask: int, flips: list[int]) -> Column:
        own = F.col("fp").bitwiseAND(F.lit(signed(mask)))
        return F.transform(F.array(*[F.lit(signed(f)) for f in flips]), lambda f: F.struct(F.lit(k).alias("part"), own.bitwiseXOR(f).alias("value"), (f != 0).alias("probe")))

    parts = [values(k, mask, flips) for k, (mask, flips) in enumerate(plan)]
    return fps.select("*", F.explode(F.flatten(F.array(*parts))).alias("e")).select("*", "e.*").drop("e")


def forest(fps: np.ndarray, probe: np.ndarray, radius: int, block: int = 1024, real: bool = False) -> np.ndarray:
    """Trees that span the components of the links among `fps` in a bucket, fewer edges than it has members.
    Blocks bound the memory; two blocks whose members are all connected aren't compared. Trees are of a bounded degree, or
    with `real` made of links themselves."""
    u = np.unique(fps)
    own = np.zeros(len(u), bool)
    own[np.searchsorted(u, fps[~probe])] = True
    n = len(u)
    label, found = np.arange(n), [np.zeros((0, 2), np.int64)]
    for i in range(0, n, block):
        for j in range(i, n, block):
            la, lb = label[i : i + block], label[j : j + block]
            if la[0] == lb[0] and (la == la[0]).all() and (lb == la[0]).all():
                continue
            a, b = u[i : i + block], u[j : j + block]
            close = np.bitwise_count(a[:, None] ^ b[None, :]) <= radius
            close &= own[i : i + block, None] | own[None, j : j + block]
            x, y = np.nonzero(close)
            x, y = x + i, y + j
            new = label[x] != label[y]
            if new.any() and real:
                found.append(spanning(label, x[new], y[new]))
            elif new.any():
                merge(label, x[new], y[new])
    return u[np.concatenate(found) if real else trees(label)]


def spanning(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Those of the links x[i], y[i] that are enough to join the components of `label` (changed in place)."""
    found = []
    while (apart := label[x] != label[y]).any():
        x, y = x[apart], y[apart]
        # each label is joined to a lesser one by one link, so there are no circles
        one = np.unique(np.maximum(label[x], label[y]), return_index=True)[1]
        found.append(np.stack([x[one], y[one]], axis=1))
        merge(label, x[one], y[one])
    return np.concatenate(found)


def trees(label: np.ndarray) -> np.ndarray:
    """(child, parent) places: a tree over the members of each label, no node of which has over ARITY children."""
    order = np.argsort(label, kind="stable")
    sorted_ = label[order]
    head = np.searchsorted(sorted_, sorted_)
    place = np.arange(len(label)) - head
    child = np.flatnonzero(place > 0)
    return np.stack([order[child], order[head[child] + (place[child] - 1) // ARITY]], axis=1)


def merge(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Join the components of x[i] and y[i] in `label` (changed in place)."""
    while True:
        lx, ly = label[x], label[y]
        if (lx == ly).all():
            break
        least = np.minimum(lx, ly)
        np.minimum.at(label, lx, least)
        np.minimum.at(label, ly, least)
        while (label != label[label]).any():
            label[:] = label[label]


def branched(edges: DataFrame) -> DataFrame:
    """(a, b) links -> others with the same components, of a bounded degree within each batch: a map-side step
    that keeps hubs from being one key with very many rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
            nodes, at = np.unique(ends, return_inverse=True)
            label, at = np.arange(len(nodes)), at.reshape(2, -1)
            merge(label, at[0], at[1])
            out = np.sort(nodes[trees(label)], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], ["a", "b"])

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def closed_buckets(fps: np.ndarray, probe: np.ndarray, starts: np.ndarray, radius: int, real: bool) -> list[np.ndarray]:
    """forest() of each bucket that begins at `starts`, but for the last, which may go on. The small ones are compared
    together, each row with the next one of its bucket, then with the one after that, and so on."""
    size = np.diff(starts)
    large = size > SMALL_BUCKET
    found = [forest(fps[s : s + n], probe[s : s + n], radius, real=real) for s, n in zip(starts[:-1][large].tolist(), size[large].tolist())]
    first, end = starts[0], starts[-1]
    fps, own = fps[first:end], ~probe[first:end]
    behind = np.where(np.repeat(large, size), 0, np.repeat(starts[1:] - first, size) - np.arange(1, len(fps) + 1))
    links, at, step = [np.zeros((2, 0), np.int64)], np.flatnonzero(behind), 1
    while len(at):
        near = (np.bitwise_count(fps[at] ^ fps[at + step]) <= radius) & (own[at] | own[at + step])
        links.append(np.stack([at[near], at[near] + step]))
        step += 1
        at = at[behind[at] >= step]
    x, y = np.concatenate(links, axis=1)
    label = np.arange(len(fps))
    if len(x) and real:
        found.append(fps[spanning(label, x, y)])
    elif len(x):
        merge(label, x, y)
        found.append(fps[trees(label)])
    return [f for f in found if len(f)]


def verified(entries: DataFrame, keys: list[str], radius: int, real: bool = False) -> DataFrame:
    """(a, b): links within each bucket, as spanning forests. A bucket's rows are streamed in key order,
    so a task holds one bucket at a time."""
    rows = entries.select(F.xxhash64(*keys).alias("k"), *keys, "fp", "probe").repartition("k").sortWithinPartitions("k", *keys)
    width = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []  # of the bucket that may go on in the next batch
        last: tuple | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(1 + i).to_numpy(zero_copy_only=False) for i in range(width)]
            fps = batch.column(1 + width).to_numpy(zero_copy_only=False).view(np.uint64)
            probe = batch.column(2 + width).to_numpy(zero_copy_only=False).astype(bool)
            change = np.zeros(len(fps), bool)
            for c in cols:
                change[1:] |= c[1:] != c[:-1]
            starts = np.append(0, np.flatnonzero(change))
            edges: list[np.ndarray] = []
            if held:
                if last == tuple(c[0] for c in cols):
                    end = starts[1] if len(starts) > 1 else len(fps)
                    held.append((fps[:end], probe[:end]))
                    starts = starts[1:]
                if len(starts):
                    edges += close_bucket(held)
            if len(starts):
                edges += closed_buckets(fps, probe, starts, radius, real)
                held = [(fps[starts[-1] :], probe[starts[-1] :])]
            last = tuple(c[-1] for c in cols)
            if edges:
                yield out(edges)
        if held and (edges := close_bucket(held)):
            yield out(edges)

    def out(edges: list[np.ndarray]) -> pa.RecordBatch:
        e = np.concatenate(edges).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], ["a", "b"])

    def close_bucket(held: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        if len(held) == 1 and len(held[0][0]) == 1:
            return []
        found = forest(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), radius, real=real)
        return [found] if len(found) else []

    return rows.mapInArrow(run, "a long, b long")


def sampled(distinct: DataFrame, sample: int) -> np.ndarray:
    """One fingerprint for each of `sample` hash buckets, the one with the least of another hash there. The least fingerprint
    itself would have ever more leading bits alike as the table grows, and those partitions would seem crowded."""
    bucket = F.pmod(F.xxhash64("fp"), F.lit(sample)).alias("b")
    seen = distinct.groupBy(bucket).agg(F.min_by("fp", F.xxhash64(F.lit(SEED), "fp")).alias("fp")).collect()
    return np.array([r.fp for r in seen], np.int64).view(np.uint64)


def links(distinct: DataFrame, radius: int = RADIUS, sample: int = SAMPLE, large: int = LARGE_BUCKET, real: bool = False) -> DataFrame:
    """Spanning edges (a, b) among distinct fingerprints `fp` within `radius` bits of each other; with `real` each edge is of
    two such fingerprints, else trees of a bounded degree join the same ones."""
    rows = distinct.count()
    if rows < 2:
        return distinct.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where("false")
    bits = to_bits(sampled(distinct, sample))
    plans, free = [], list(range(64))
    groups = bit_groups(bits, free, radius + 1)
    first = masks(groups, thresholds(bits, groups, radius, rows))
    entries = _entries(distinct.select("fp"), first)
    counts = entries.groupBy("part", "value").agg(F.count("*").alias("n")).where(F.col("n") > large)
    # Second level: the bits outside a partition are partitioned again for its crowded values.
    heavy = materialize(counts)
    most = {r.part: r.n for r in heavy.groupBy("part").agg(F.max("n").alias("n")).collect()}  # one row a partition
    found = []
    if not most:
        return verified(entries, ["part", "value"], radius, real)
    h = heavy.select(F.col("part").alias("hp"), F.col("value").alias("hv"))
    same = (F.col("part") == F.col("hp")) & (F.col("value") == F.col("hv"))
    found.append(verified(entries.join(h, same, "left_anti"), ["part", "value"], radius, real))
    crowded = entries.join(h, same, "left_semi")
    for k, (mask, _) in enumerate(first):
        if k not in most:
            continue
        rest = [b for b in range(64) if not mask >> b & 1]
        # fingerprints of one bucket may be alike on the partition, so the rest may use the whole radius
        deep = bit_groups(bits, rest, radius + 1)
        plan = masks(deep, thresholds(bits, deep, radius, most[k]))
        sub = crowded.where(F.col("part") == k).select("fp", F.col("value").alias("outer"), F.col("probe").alias("outer_probe"))
        below = _entries(sub, plan).select(
            F.lit(k).alias("outer_part"), "outer", "part", "value", "fp", F.col("outer_probe").alias("probe")
        )
        plans.append(below)
    for below in plans:
        found.append(verified(below, ["outer_part", "outer", "part", "value"], radius, real))
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


def components(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(a, b) links -> (node, root), root the least node of the component, for all nodes with a link."""
    with plain_planning(edges.sparkSession):
        return contracted(edges, most_rounds)


def contracted(edges: DataFrame, most_rounds: int) -> DataFrame:
    """Each round orders the nodes anew by a hash, hooks every node to the first one within two links in that
    order, shortens the paths by a pointer jump, and contracts the edges. As the order is random, descending
    chains are short and a constant share of the nodes goes each round, on paths; stars go at once. Rounds are cut off by checkpoints; nothing but counts reaches the driver.
    """
    live = materialize(branched(edges.where("a <> b")).distinct())
    parents = []
    for turn in range(most_rounds):
        if live.isEmpty():
            break
        both = live.select(F.col("a").alias("v"), F.col("b").alias("n")).union(live.select(F.col("b").alias("v"), F.col("a").alias("n")))
        place = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("h"), F.col(c).alias("id"))  # noqa: E731, B023
        near = both.groupBy("v").agg(F.least(F.min(place("n")), F.min(place("v"))).alias("m"))
        near = near.select(F.col("v").alias("nv"), "m")
        hook = both.join(near, F.col("n") == F.col("nv")).groupBy("v").agg(F.min("m").alias("m")).select("v", F.col("m.id").alias("p"))
        hook = materialize(hook)
        up = hook.select(F.col("v").alias("uv"), F.col("p").alias("up"))
        hook = hook.join(up, F.col("p") == F.col("uv")).select("v", F.col("up").alias("p"))
        hook = materialize(hook)
        parents.append(hook)
        pa_ = hook.select(F.col("v").alias("av"), F.col("p").alias("ap"))
        pb_ = hook.select(F.col("v").alias("bv"), F.col("p").alias("bp"))
        moved = live.join(pa_, F.col("a") == F.col("av")).join(pb_, F.col("b") == F.col("bv"))
        moved = moved.select(F.least("ap", "bp").alias("a"), F.greatest("ap", "bp").alias("b")).where("a <> b")
        live = materialize(branched(moved).distinct())
    else:
        raise RuntimeError("components did not settle")
    if not parents:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("root")).where("false")
    # compose from the last round back: root(v) = root_later(parent(v)), or the parent where no later round has it
    roots = parents[-1].select(F.col("v").alias("node"), F.col("p").alias("root"))
    for hook in reversed(parents[:-1]):
        later = roots.select(F.col("node").alias("ln"), F.col("root").alias("lr"))
        roots = hook.join(later, F.col("p") == F.col("ln"), "left").select(F.col("v").alias("node"), F.coalesce("lr", "p").alias("root"))
    roots = materialize(roots)
    least = roots.groupBy(F.col("root").alias("r")).agg(F.least(F.min("node"), F.col("r")).alias("least"))
    return roots.join(least, F.col("root") == F.col("r")).select("node", F.col("least").alias("root"))


def fingerprint_pairs(fps: DataFrame) -> DataFrame:
    """(a, b) with a < b: links that span the components of the classes in `fps` (cls, fp) whose fingerprints differ in
    RADIUS bits or fewer. Classes of one fingerprint are a chain, so that none is in very many links."""
    distinct = materialize(fps.groupBy("fp").agg(F.min("cls").alias("first")))
    ends = [distinct.select(F.col("fp").alias(f"fp_{c}"), F.col("first").alias(f"cls_{c}")) for c in "ab"]
    found = links(distinct.select("fp"), real=True).where("a <> b").distinct()
    found = found.join(ends[0], F.col("a") == F.col("fp_a")).join(ends[1], F.col("b") == F.col("fp_b"))
    chain = fps.select("cls", F.lag("cls").over(Window.partitionBy("fp").orderBy("cls")).alias("before")).where("before IS NOT NULL")
    return found.select(F.least("cls_a", "cls_b").alias("a"), F.greatest("cls_a", "cls_b").alias("b")).unionByName(chain.select(F.col("before").alias("a"), F.col("cls").alias("b"))).distinct()


def of_roots(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """(a, b, ra, rb): pairs with the roots of both ends, themselves where they have no link."""
    own = [roots.select(F.col("node").alias(f"n{c}"), F.col("root").alias(f"r{c}")) for c in "ab"]
    both = pairs.join(own[0], F.col("a") == F.col("na"), "left").join(own[1], F.col("b") == F.col("nb"), "left")
    return both.select("a", "b", F.coalesce("ra", "a").alias("ra"), F.coalesce("rb", "b").alias("rb"))


def joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) after `links` (a, b) between roots, or nodes that had no link so far."""
    if links.isEmpty():
        return roots
    later = materialize(components(links))
    own = later.select(F.col("node").alias("ln"), F.col("root").alias("lr"))
    known = roots.join(own, F.col("root") == F.col("ln"), "left").select("node", F.coalesce("lr", "root").alias("root"))
    return known.unionByName(later.join(roots.select("node"), "node", "left_anti").select("node", "root"))


def least_of_roots(nodes: DataFrame, roots: DataFrame, key: str, name: str | None = None) -> DataFrame:
    """nodes (key, first_id), unique in `key`, and (node, root) of those with links -> (c, least_id): the least
    first_id of each node's component; c is the key, or the column `name`. A component of very many nodes is spread over tasks."""
    c = F.col(name or key).alias("c")
    linked = nodes.join(roots, F.col(key) == F.col("node"), "left")
    alone = linked.where("root IS NULL").select(c, F.col("first_id").alias("least_id"))
    grouped = materialize(linked.where("root IS NOT NULL").select(c, "first_id", "root", F.pmod(F.xxhash64(key), F.lit(WAYS)).alias("way")))
    least = grouped.groupBy("root").agg(F.min("first_id").alias("least_id"))
    least = least.select(F.col("root").alias("r"), "least_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(WAYS - 1).cast("long"))).alias("w"))
    named = grouped.join(least, (F.col("root") == F.col("r")) & (F.col("way") == F.col("w"))).select("c", "least_id")
    return alone.unionByName(named)


def of_each(rows: DataFrame, key: str, named: DataFrame, counts: DataFrame) -> DataFrame:
    """Join `rows` with `named` (c, ...), unique in c, on key = c. Keys that `counts` (c, n) says have over HOT rows,
    of which there are few, are joined by broadcast, so none of them is one task's."""
    hot = materialize(counts.where(F.col("n") > HOT).select(F.col("c").alias("h")))
    few = hot.count()
    if not few or few > 1_000_000:
        return rows.join(named, F.col(key) == F.col("c"))
    apart = named.join(F.broadcast(hot), F.col("c") == F.col("h"), "left_semi")
    cold = rows.join(F.broadcast(hot), F.col(key) == F.col("h"), "left_anti").join(named, F.col(key) == F.col("c"))
    return cold.unionByName(rows.join(F.broadcast(apart), F.col(key) == F.col("c")))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, width: int = SHINGLE) -> DataFrame:
    """doc_id, fp, component_id for every row of `docs`."""
    fps = materialize(fingerprints(docs, width=width))
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")))
    roots = components(links(distinct.select("fp"), radius))
    named = materialize(least_of_roots(distinct.select("fp", "first_id"), roots, "fp"))
    return of_each(fps, "fp", named, distinct.select(F.col("fp").alias("c"), "n")).select("doc_id", "fp", F.col("least_id").alias("component_id"))


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- the pipeline's stage ------------------------------------------------------------------------

#: Five-word shingles, and eight fingerprints of 64 bits, so that similarity can be estimated from the distance.
STAGE_SHINGLE = 5
STAGE_WORDS = 8
STAGE_SIMILARITY = 0.8
#: Candidates agree on all least hashes of a band: at a similarity of 0.8 with probability 1 - (1 - 0.8^5)^24 = 0.9999.
STAGE_BANDS = 24
STAGE_BAND_ROWS = 5
#: A bucket above this is compared in parts first; see copies_to_drop(). Later comparisons deal buckets in parts of this size.
STAGE_BUCKET = 4096
#: Bytes of shingle sets on a side of a meeting.
STAGE_BYTES = 1 << 24
#: Classes that a task remembers to have passed on.
REMEMBERED = 100_000
#: How many deviations beyond the mean at the threshold a candidate's distance may lie.
STAGE_DEVIATIONS = 4
_GOLDEN = 0x9E3779B97F4A7C15


def spread(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th of independent 64-bit hashes made from one (the splitmix64 finaliser; fixed constants)."""
    x = h + np.uint64((k + 1) * _GOLDEN & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, width: int = STAGE_SHINGLE) -> tuple[np.ndarray, bytes]:
    """The sorted hashes of a text's distinct shingles, and the name of its class."""
    found = [np.unique(run_hashes(words, width)) for words in word_runs(text, width)]
    return (np.unique(np.concatenate(found)) if len(found) > 1 else found[0] if found else np.zeros(0, np.uint64)), class_of(text)


def class_of(text: str | None) -> bytes:
    """128 bits of a text's lower-cased words: texts of the same words are one class."""
    digest, first = xxhash.xxh3_128(), True
    for part in text_chunks(text or "", LONG):
        words = part.encode("utf-8", "surrogatepass").lower().split()
        if words:
            digest.update(b" ".join(words) if first else b" " + b" ".join(words))
            first = False
    return digest.digest()


def wide_bits(hashes: np.ndarray, words: int = STAGE_WORDS) -> list[int]:
    """The fingerprints of a set of shingle hashes."""
    if not len(hashes):
        return [0] * words
    counts = np.zeros(64 * words, np.int64)
    for at in range(0, len(hashes), 255):
        block = np.stack([spread(hashes[at : at + 255], k) for k in range(words)], axis=1)
        counts += np.unpackbits(block.astype(">u8").view(np.uint8).reshape(len(block), -1), axis=1).sum(axis=0, dtype=np.uint8)
    bits = np.packbits(2 * counts > len(hashes)).view(">u8")
    return [int(b) for b in bits]


_TIMES = spread(np.arange(STAGE_BANDS * STAGE_BAND_ROWS, dtype=np.uint64), 0) | np.uint64(1)
_PLUS = spread(np.arange(STAGE_BANDS * STAGE_BAND_ROWS, dtype=np.uint64), 1)


def band_keys(hashes: np.ndarray) -> list[int]:
    """One key a band: a hash of the least values that the band's hash functions take on the shingles."""
    least = np.full(len(_TIMES), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1024):
        np.minimum(least, (hashes[at : at + 1024, None] * _TIMES + _PLUS).min(axis=0), out=least)
    return [xxhash.xxh3_64_intdigest(row.tobytes(), k) for k, row in enumerate(least.reshape(STAGE_BANDS, -1))]


def stage_radius(similarity: float = STAGE_SIMILARITY, bits: int = 64 * STAGE_WORDS) -> int:
    """The distance that texts of this Jaccard similarity have on average, and some standard deviations more."""
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(bits * share + STAGE_DEVIATIONS * np.sqrt(bits * share * (1 - share)))


def nearest_forest(fp: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Pairs of rows within `radius` bits that span the components of all such pairs, the closest first
    (Prim's algorithm; memory is linear in the rows)."""
    n = len(fp)
    near, parent, left = np.full(n, 1 << 30), np.zeros(n, np.int64), np.ones(n, bool)
    found, at = [], 0
    for _ in range(n):
        left[at] = False
        d = np.bitwise_count(fp ^ fp[at]).sum(axis=1, dtype=np.int64)
        closer = left & (d < near)
        near[closer], parent[closer] = d[closer], at
        near[at] = 1 << 31
        at = int(near.argmin())
        if left[at] and near[at] <= radius:
            found.append((int(parent[at]), at))
        if not left[at]:
            break
    return found


def whole_keys(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[np.ndarray]:
    """Batches sorted by their first column as arrays of `width` columns, cut where that column changes."""
    left: np.ndarray | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = np.stack([batch.column(i).to_numpy() for i in range(width)], axis=1)
        if left is not None:
            now = np.concatenate((left, now))
        # the last key may go on in the next batch
        cut = int(np.searchsorted(now[:, 0], now[-1, 0], side="left"))
        left = now[cut:]
        if cut:
            yield now[:cut]
    if left is not None:
        yield left


def gathered(found: Iterator[np.ndarray], names: list[str], rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Arrays with these columns as batches of about so many rows."""
    held, size = [], 0
    for some in found:
        held.append(some)
        size += len(some)
        if size > rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(held).T], names)
            held, size = [], 0
    if size:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(held).T], names)


def runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal keys begins, and its length."""
    head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return head, np.diff(np.concatenate((head, [len(key)])))


def bucket_pairs(entries: DataFrame, radius: int, words: int = STAGE_WORDS) -> DataFrame:
    """(k, a, b) with a < b: a forest of the closest pairs within `radius` bits in each bucket k of `entries`
    (k, cls, w0...)."""
    names = [f"w{k}" for k in range(words)]
    rows = entries.select("k", "cls", *names).repartition("k").sortWithinPartitions("k", "cls")

    def within(rows: np.ndarray) -> Iterator[np.ndarray]:
        key, ids, fp = rows[:, 0], rows[:, 1], np.ascontiguousarray(rows[:, 2:]).view(np.uint64)
        head, size = runs(key)
        x = head[size == 2]
        x = x[np.bitwise_count(fp[x] ^ fp[x + 1]).sum(axis=1) <= radius]
        yield np.stack([key[x], ids[x], ids[x + 1]], axis=1)
        for s, m in zip(head[size > 2].tolist(), size[size > 2].tolist()):
            pairs = np.array(nearest_forest(fp[s : s + m], radius), np.int64).reshape(-1, 2) + s
            yield np.stack([key[pairs[:, 0]], ids[pairs].min(axis=1), ids[pairs].max(axis=1)], axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_keys(batches, 2 + words):
            yield from gathered(within(part), ["k", "a", "b"])

    return rows.mapInArrow(run, "k long, a long, b long")


def meetings(entries: DataFrame, words: int, sets: DataFrame | None = None) -> DataFrame:
    """The rows of `entries` (k, cls, root, w0...) that have to meet, by the `key` of their meeting; with `sets` (node, s)
    also their shingle sets, whose sizes in bytes are then the column m of `entries`.

    Rows of a bucket's largest root needn't be compared with each other: only the others, its strays, meet all
    rows. Strays are dealt over groups and all rows over blocks, each of about STAGE_BUCKET rows and STAGE_BYTES of
    sets, and a task holds one meeting of a group and a block at a time, however large the bucket.
    """
    names = [f"w{k}" for k in range(words)]
    bytes_ = F.lit(0) if sets is None else F.col("m")
    of_root = entries.groupBy("k", "root").agg(F.count("*").alias("n"), F.sum(bytes_).alias("m"))
    sizes = of_root.groupBy("k").agg(F.sum("n").alias("n"), F.sum("m").alias("m"), F.max(F.struct("n", "root", "m")).alias("top"))
    parts = lambda n, m: F.ceil(F.greatest(n / F.lit(STAGE_BUCKET), m / F.lit(STAGE_BYTES))).cast("long")
    sizes = sizes.where("n > top.n").select(F.col("k").alias("c"), "n", F.col("top.root").alias("main"), parts(F.col("n") - F.col("top.n"), F.col("m") - F.col("top.m")).alias("groups"), parts(F.col("n"), F.col("m")).alias("blocks"))
    sizes = materialize(sizes)
    rows = of_each(entries, "k", sizes.drop("n"), sizes.select("c", "n"))
    if sets is not None:
        rows = rows.join(sets.select(F.col("node").alias("of"), "s"), F.col("cls") == F.col("of"))
    stray = F.col("root") != F.col("main")
    rows = rows.withColumn("stray", stray.cast("long")).withColumn("group", F.pmod(F.xxhash64(F.lit(1), "cls"), "groups")).withColumn("block", F.pmod(F.xxhash64(F.lit(2), "cls"), "blocks"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = ["stray", "cls", "root", *names, *(["s"] if sets is not None else [])]
    asking = rows.where("stray = 1").select("k", "group", every("blocks").alias("block"), F.lit(0).cast("long").alias("side"), *own)
    asked = rows.select("k", every("groups").alias("group"), "block", F.lit(1).cast("long").alias("side"), *own)
    met = asking.unionByName(asked).select(F.xxhash64("k", "group", "block").alias("key"), "side", *own)
    return met.repartition("key").sortWithinPartitions("key", "side")


def crossing_pairs(entries: DataFrame, radius: int, words: int = STAGE_WORDS, ends: bool = False) -> DataFrame:
    """(a, b) with a < b: all pairs within `radius` bits that share a bucket k of `entries` (k, cls, root, w0...)
    and whose roots differ. With `ends` not the pairs, whose number may be the square of a bucket's rows, but (node):
    the classes that are in any, once for each meeting."""

    def within(rows: np.ndarray) -> Iterator[np.ndarray]:
        side, stray, ids, root = rows[:, 1], rows[:, 2], rows[:, 3], rows[:, 4]
        fp = np.ascontiguousarray(rows[:, 5:]).view(np.uint64)
        for s, m in zip(*(x.tolist() for x in runs(rows[:, 0]))):
            middle, end = s + int(m - side[s : s + m].sum()), s + m
            paired = np.zeros(m, bool)
            for i in range(s, middle):
                # two strays meet twice
                near = (root[middle:end] != root[i]) & ((stray[middle:end] == 0) | (ids[middle:end] > ids[i]))
                y = middle + np.flatnonzero(near)
                y = y[np.bitwise_count(fp[y] ^ fp[i]).sum(axis=1) <= radius]
                if len(y) and ends:
                    paired[y - s] = paired[i - s] = True
                elif len(y):
                    yield np.stack([np.minimum(ids[y], ids[i]), np.maximum(ids[y], ids[i])], axis=1)
            if paired.any():
                yield np.unique(ids[s:end][paired])[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_keys(batches, 5 + words):
            yield from gathered(within(part), ["node"] if ends else ["a", "b"])

    return meetings(entries, words).mapInArrow(run, "node long" if ends else "a long, b long")


def crossing_links(entries: DataFrame, sets: DataFrame, radius: int, words: int = STAGE_WORDS) -> DataFrame:
    """(a, b): trees over the roots of `entries` (k, cls, root, m, w0...) that are linked by two rows of a bucket k within
    `radius` bits whose shingle sets, in `sets` (node, s), are alike.

    A meeting compares the sets itself and returns fewer links than it has roots, so that a bucket of near copies none
    of which are alike makes no rows."""

    def within(rows: pa.Table) -> np.ndarray:
        side, ids, root = (rows[c].to_numpy() for c in ("side", "cls", "root"))
        fp = np.stack([rows[f"w{k}"].to_numpy() for k in range(words)], axis=1).view(np.uint64)
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows["s"]]
        roots, at = np.unique(root, return_inverse=True)
        label, asking, asked = np.arange(len(roots)), np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        for p in range(0, len(asking), 256):
            for q in range(0, len(asked), 1024):
                x, y = asking[p : p + 256], asked[q : q + 1024]
                near = label[at[x]][:, None] != label[at[y]][None, :]
                if not near.any():
                    continue
                bits = np.zeros(near.shape, np.int32)
                for k in range(words):
                    bits += np.bitwise_count(fp[x, k][:, None] ^ fp[y, k][None, :])
                near &= bits <= radius
                u, w = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
                if not len(u):
                    continue
                near = near[np.ix_(u, w)]
                i, j = np.nonzero(near & alike_sets([sets[k] for k in x[u]], [sets[k] for k in y[w]], near))
                if len(i):
                    merge(label, at[x[u[i]]], at[y[w[j]]])
        return roots[trees(label)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from gathered((found for rows in tables_by_key(batches) if len(found := within(rows))), ["a", "b"])

    return meetings(entries, words, sets).mapInArrow(run, "a long, b long")


def tables_by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches sorted by their first column, a table for each of its values."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        for s, n in zip(*(x.tolist() for x in runs(key))):
            if held and key[s] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(s, n))
            last = key[s]
    if held:
        yield pa.Table.from_batches(held)


def alike_sets(left: list[np.ndarray], right: list[np.ndarray], near: np.ndarray, width: int = 2048) -> np.ndarray:
    """Whether the Jaccard similarity of left[i] and right[j] is STAGE_SIMILARITY or more, for the pairs marked in `near` at
    least. Few pairs are compared one by one; many as products of 0/1 matrices over `width` shingles at a time."""
    if near.sum() <= 4 * sum(near.shape):
        out = np.zeros(near.shape, bool)
        for i, j in zip(*np.nonzero(near)):
            out[i, j] = jaccard(left[i], right[j]) >= STAGE_SIMILARITY
        return out
    sizes = [np.array([len(x) for x in side], np.int64) for side in (left, right)]
    of = [np.repeat(np.arange(len(n)), n) for n in sizes]
    flat = [np.concatenate(side) for side in (left, right)]
    shared = np.intersect1d(*flat)
    common = np.zeros(near.shape)
    place = [np.searchsorted(shared, x) for x in flat]
    here = [(k < len(shared)) & (shared[np.minimum(k, len(shared) - 1)] == x) if len(shared) else np.zeros(len(x), bool) for k, x in zip(place, flat)]
    of, place = [x[h] for x, h in zip(of, here)], [x[h] for x, h in zip(place, here)]
    for start in range(0, len(shared), width):
        cells = []
        for x, k, n in zip(of, place, near.shape):
            own = (k >= start) & (k < start + width)
            one = np.zeros((n, min(width, len(shared) - start)), np.float32)
            one[x[own], k[own] - start] = 1
            cells.append(one)
        common += cells[0] @ cells[1].T
    union = sizes[0][:, None] + sizes[1][None, :] - common
    return np.where(union > 0, common / np.maximum(union, 1), 1.0) >= STAGE_SIMILARITY


def shingle_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, s): the sorted shingle hashes of each class in `nodes` (node, name), from one of its texts."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task passes on one text of a class, so that a text with very many copies is few rows; of what it has
        passed on it remembers a bounded number of classes at a time."""
        seen: set[bytes] = set()
        for batch in batches:
            for part in text_slices(batch, "text", 1 << 21):
                names = [class_of(x.as_py()) for x in part.column(0)]
                if len(seen) > REMEMBERED:
                    seen.clear()
                fresh = [k for k, c in enumerate(names) if not (c in seen or seen.add(c))]
                kept = pa.array([names[k] for k in fresh], pa.binary())
                yield pa.RecordBatch.from_arrays([kept, part.column(0).take(pa.array(fresh, pa.int64()))], ["cls", "text"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text", 1 << 21):
                found = [shingle_hashes(x.as_py())[0].tobytes() for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.binary())], ["node", "s"])

    # texts are streamed past a hash table of the nodes, and grouped where the join has put them: they are dealt once
    texts = docs.select("text").mapInArrow(name, "cls binary, text string").join(nodes.hint("shuffle_hash"), F.col("cls") == F.col("name"))
    return texts.groupBy("cls", "node").agg(F.first("text").alias("text")).select("node", "text").mapInArrow(sets, "node long, s binary")


def with_similarity(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, alike): whether the shingle sets of a and b have a Jaccard similarity of STAGE_SIMILARITY or more."""
    left, right = (sets.select(F.col("node").alias(f"n{c}"), F.col("s").alias(f"s{c}")) for c in "ab")
    both = pairs.join(left, F.col("a") == F.col("na")).join(right, F.col("b") == F.col("nb")).select("a", "b", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike = []
            for x, y in zip(batch.column(2), batch.column(3)):
                u, v = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                alike.append(jaccard(u, v) >= STAGE_SIMILARITY)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(alike, pa.bool_())], ["a", "b", "alike"])

    return both.mapInArrow(run, "a long, b long, alike boolean")


def jaccard(u: np.ndarray, v: np.ndarray) -> float:
    """Similarity of two sorted arrays without repeats."""
    common = len(np.intersect1d(u, v, assume_unique=True))
    union = len(u) + len(v) - common
    return common / union if union else 1.0


def copies_to_drop(docs: DataFrame, radius: int | None = None, words: int = STAGE_WORDS) -> tuple[DataFrame, DataFrame]:
    """(ids of documents that are near copies of a kept one, ids on which equal rows repeat)."""
    radius = stage_radius() if radius is None else radius
    names = [f"w{k}" for k in range(words)]
    bands = [f"b{k}" for k in range(STAGE_BANDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text", 1 << 21):
                got = [shingle_hashes(x.as_py()) for x in part.column(1)]
                values = np.array([[*wide_bits(h, words), *band_keys(h)] for h, _ in got], np.uint64).view(np.int64)
                called = pa.array([name for _, name in got], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), called, *(pa.array(c) for c in values.T)], ["doc_id", "name", *names, *bands])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    fps = materialize(narrow.mapInArrow(run, "doc_id long, name binary, " + ", ".join(f"{n} long" for n in names + bands)))
    # classes are told by 128 bits; from here on each has a number
    classes = fps.groupBy("name").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"), *(F.first(n).alias(n) for n in names + bands))
    classes = materialize(classes.withColumn("cls", F.monotonically_increasing_id()))
    called = classes.select("name", F.col("cls").alias("called"))
    entries = classes.select("cls", *names, F.explode(F.array(*bands)).alias("k"))
    # SimHash first: fingerprints within RADIUS bits by the generalised pigeonhole principle, as in op8_simhash, each
    # link judged on the shingle sets. Copies at the least similarity differ in about ten bits, more than pigeonholes can
    # find; so bands look for what is still apart.
    close = materialize(fingerprint_pairs(classes.select("cls", F.col("w0").alias("fp"))))
    # The closest pairs that span each bucket are compared first. Where all of a bucket's are alike, the rest
    # of its pairs are linked anyway; in other buckets all pairs that aren't linked by then are compared.
    # Very large buckets are first compared in parts, each a task's, and with the part's least class; they count
    # as buckets with unlike pairs.
    large = materialize(entries.groupBy("k").agg(F.count("*").alias("m")).where(F.col("m") > STAGE_BUCKET).select(F.col("k").alias("lk"), "m"))
    any_large = not large.isEmpty()
    own = F.col("k") == F.col("lk")
    small = materialize(bucket_pairs(entries.join(large, own, "left_anti") if any_large else entries, radius, words))
    forest_ = small
    if any_large:
        parted = materialize(entries.join(large, own).withColumn("part", F.pmod(F.xxhash64("cls"), F.ceil(F.col("m") / STAGE_BUCKET))))
        heads = parted.groupBy("k", "part").agg(F.min("cls").alias("head"))
        heads = parted.join(heads.select("head", F.col("k").alias("hk")), (F.col("cls") == F.col("head")) & (F.col("k") == F.col("hk")))
        within = bucket_pairs(parted.select(F.xxhash64("k", "part").alias("k"), "cls", *names), radius, words)
        among = bucket_pairs(heads.select(F.xxhash64("k", F.lit(-1)).alias("k"), "cls", *names), radius, words)
        forest_ = small.unionByName(materialize(within.unionByName(among)))
    nodes = forest_.select("a", "b").unionByName(close).select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = materialize(shingle_sets(docs, nodes.join(called, F.col("node") == F.col("called"))))
    # written first: a second Python step in the same tasks would double an executor's Python workers, which it then keeps
    linked = materialize(with_similarity(close, sets).where("alike").select("a", "b"))
    roots = materialize(components(linked))
    apart = materialize(of_roots(forest_.select("a", "b").distinct(), roots).where("ra <> rb"))
    judged = materialize(with_similarity(apart.select("a", "b"), sets))
    roots = joined(roots, materialize(judged.where("alike").join(apart, ["a", "b"]).select(F.col("ra").alias("a"), F.col("rb").alias("b"))))
    unlike = judged.where("NOT alike").select(F.col("a").alias("ua"), F.col("b").alias("ub"))
    if any_large or not unlike.isEmpty():
        roots = materialize(roots)
        rooted = lambda rows: rows.join(classes.select(F.col("cls").alias("own"), *names), F.col("cls") == F.col("own")).join(roots, F.col("cls") == F.col("node"), "left").select("k", "cls", F.coalesce("root", "cls").alias("root"), *names)
        open_ = small.join(unlike, (F.col("a") == F.col("ua")) & (F.col("b") == F.col("ub")), "left_semi").select(F.col("k").alias("open")).distinct()
        # both ends of a pair within the radius are in their bucket's forest, so other rows of it needn't meet; of a
        # large bucket those that have such a pair are found first, and the sets that aren't at hand are made
        again = small.join(open_, F.col("k") == F.col("open"), "left_semi").select("k", F.explode(F.array("a", "b")).alias("cls")).distinct()
        if any_large:
            crowd = parted.select("k", "cls")
            ends = materialize(crossing_pairs(rooted(crowd), radius, words, ends=True).distinct())
            again = again.unionByName(crowd.join(ends, F.col("cls") == F.col("node"), "left_semi"))
            missing = ends.join(nodes, "node", "left_anti")
            sets = materialize(sets.unionByName(shingle_sets(docs, missing.join(called, F.col("node") == F.col("called")))))
        again = rooted(again).join(sets.select("node", F.octet_length("s").alias("m")), F.col("cls") == F.col("node")).drop("node")
        roots = joined(roots, materialize(crossing_links(again, sets, radius, words)))
    named = least_of_roots(classes.select("cls", "name", "first_id"), roots, "cls", "name").select("c", F.col("least_id").alias("kept_id"))
    own = of_each(fps.select("doc_id", "name"), "name", materialize(named), classes.select(F.col("name").alias("c"), "n"))
    drop = own.where(~F.col("doc_id").eqNullSafe(F.col("kept_id"))).select("doc_id")
    kept = own.where(F.col("doc_id").eqNullSafe(F.col("kept_id"))).select("doc_id")
    repeats = fps.groupBy("doc_id", "name").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("doc_id")
    return drop.join(kept, "doc_id", "left_anti").distinct(), repeats.distinct()


def stage_simhash(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near copies the document with the least id stays.

    Near copies have a Jaccard similarity of 0.8 or more on their sets of five-word shingles, or are linked
    by such. SimHash fingerprints within RADIUS bits are found first, by the generalised pigeonhole principle; what
    they leave apart is looked for in bands of least hashes, within a distance of 512 fingerprint bits. Each pair is
    judged on its shingle sets. Null, empty and wordless texts are copies of each other. Rows that repeat a doc_id
    stand or fall together, and of equal ones among them one stays; rows without an id are copies of the least id
    of their group, if any. All columns stay as they are; an empty table stays empty.
    """
    drop, repeats = copies_to_drop(docs)
    drop = materialize(drop.select(F.col("doc_id").alias("__rw_drop")))
    # whole texts are streamed past a hash table of the ids, not sorted
    kept = docs.join(drop.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("__rw_drop")), "left_anti")
    repeats = materialize(repeats.select(F.col("doc_id").alias("__rw_again")))
    if repeats.isEmpty():
        return kept
    again = F.col("doc_id").eqNullSafe(F.col("__rw_again"))
    return kept.join(repeats, again, "left_anti").union(kept.join(repeats, again, "left_semi").dropDuplicates(["doc_id", "text"]))
