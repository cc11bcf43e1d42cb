"""SimHash near-duplicate detection with bit-sliced Hamming comparison.

A document's fingerprint has bit b set when b is set in more than half of the
XXH64 hashes (seed 42) of its word shingles.  Two fingerprints link when they
differ in at most ``radius`` bits.  The plan:

1. one narrow Arrow pass computes fingerprints;
2. equal fingerprints collapse to one row, so groups of exact copies cost one
   row each however large they are;
3. the 64 bits are cut into ``blocks`` blocks; fingerprints within the radius
   agree on at least ``blocks - radius`` whole blocks, so every choice of that
   many blocks is a bucket key and no link can be missed;
4. a bucket stores its members as 64 vertical bit planes.  A pivot's distance
   to 64 members per machine word is summed by carry-save counters, and a word
   block is abandoned once all its members exceed the radius.  Members found
   become pivots that sweep what isn't in their component, so a dense group
   costs about one sweep and emits a spanning forest instead of its pairs;
5. buckets over ``bucket_rows`` members are split into tiles of member ranges,
   each pair of ranges a task of its own;
6. components follow from alternating hub contraction on the links alone.

The pipeline's stage finds its pairs by the same fingerprints, of five-word
shingles, and confirms them by exact Jaccard similarity.  Pairs at 0.8 differ in
about ten bits, more than a radius can hold, so MinHash bands beside it give the
candidates that fingerprints can't see; the fingerprint's contract is op2's alone.

Every fingerprint is dealt under one key for each choice of blocks - radius
blocks: 35 at 7 blocks, 16 bytes each, twice (to count buckets and to compare).
At very many documents, more blocks give wider keys and smaller buckets: 8 blocks
and radius 4 are 70 keys of 32 bits.

Defined cases: null and empty texts have fingerprint zero, linked like any
other; texts with fewer words than a shingle hash their whole word sequence; a
bit set in exactly half of the hashes is 0; a text's shingles are counted in
parts of 65,535, however long it is; repeated rows share a component; a row with
a null doc_id never names a component, which is null if it has no other rows;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import arrow_map, cut, flagged, rows_of, scratch, table, text_batches, whole, written
from quillon.llm.xxh import xxh64_spans

SEED = 42
RADIUS = 4
SHINGLE = 4
#: At 7 blocks and radius 4 a key holds 3 blocks, about 27 bits.
BLOCKS = 7
BUCKET_ROWS = 4096
MAX_ROUNDS = 60
#: Buckets up to this size share bit planes; larger ones get their own.
SMALL = 48
#: The pipeline's stage: words of a shingle, the least similarity as a fraction, MinHash bands and minima of each, and members of a tile.
STAGE_SHINGLE = 5
SIMILAR = (4, 5)
BANDS, BAND_ROWS = 25, 5
#: Bits of a band's key that are compared.
KEY_BITS = 48
TILE_ROWS = 256
_CHARS = 1_000_000
_PIVOTS = 32
_LANES = 1 << 18


def fingerprint_batch(texts: Iterable[str | None], shingle: int = SHINGLE) -> np.ndarray:
    """The unsigned 64-bit SimHash of each text; texts share vector operations, about _CHARS characters at a time."""
    done, lines, chars = [], [], 0
    for text in texts:
        line = b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())
        lines.append(line)
        chars += len(line)
        if chars >= _CHARS:
            done.append(_fingerprint_lines(lines, shingle))
            lines, chars = [], 0
    return np.concatenate([*done, _fingerprint_lines(lines, shingle)])


def _fingerprint_lines(lines: list[bytes], shingle: int) -> np.ndarray:
    """Fingerprints of lines of words with single spaces between them."""
    out = np.zeros(len(lines), np.uint64)
    full = np.flatnonzero([len(x) > 0 for x in lines])
    if not len(full):
        return out
    out[full] = _majority(*_shingle_hashes([lines[k] for k in full], shingle))
    return out


def _majority(windows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """For each text (windows: its number of hashes, one at least) the bits that are set in over half of its hashes."""
    # Counters of 16 bits, four to a word, summed over parts of at most 65,535 shingles of a line.
    cuts, owner = [], []
    at = 0
    for k, n in enumerate(windows.tolist()):
        for part in range(0, n, 65_535):
            cuts.append(at + part)
            owner.append(k)
        at += n
    counts = np.zeros((len(windows), 4, 16), np.int64)
    lanes = np.uint64(0x0001000100010001)
    for bit in range(16):
        sums = np.add.reduceat((hashes >> np.uint64(bit)) & lanes, cuts)
        np.add.at(counts[:, :, bit], owner, sums.view(np.uint16).reshape(-1, 4))
    bits = counts.reshape(-1, 64) * 2 > windows[:, None]
    return np.ascontiguousarray(np.packbits(bits, axis=1, bitorder="little")).view("<u8").ravel()


def _shingle_hashes(lines: list[bytes], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The number of shingles of each line (none of them empty), and the hashes of all in order."""
    data = b" ".join(lines)
    ends = np.append(np.flatnonzero(np.frombuffer(data, np.uint8) == 32), len(data))
    starts = np.append(0, ends[:-1] + 1)
    sizes = np.array([x.count(b" ") + 1 for x in lines])
    last = np.cumsum(sizes) - 1
    # Shingle i runs from word i to word i + shingle - 1 of its line; a shorter line is one shingle.
    windows = np.maximum(sizes - shingle + 1, 1)
    first = np.repeat(last - sizes + 1, windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    until = np.minimum(first + shingle - 1, np.repeat(last, windows))
    return windows, xxh64_spans(data, starts[first], ends[until] - starts[first], SEED)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the signed 64-bit form of each text's fingerprint."""

    def of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = fingerprint_batch(batch.column("text").to_pylist(), shingle)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), of, "doc_id long, fp long")


class BitPlanes:
    """Fingerprints stored as 64 vertical planes of packed bits, 64 members to a word."""

    def __init__(self, values: np.ndarray, radius: int = RADIUS):
        self.n, self.radius = len(values), radius
        words = -(-self.n // 64)
        bits = np.unpackbits(np.ascontiguousarray(values, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        padded = np.zeros((words * 64, 64), np.uint8)
        padded[: self.n] = bits
        self.planes = np.ascontiguousarray(np.packbits(np.ascontiguousarray(padded.T), axis=1, bitorder="little")).view("<u8")
        #: Planes by how evenly they split the members: uneven bits rarely tell members apart and come last.
        self.order = np.argsort(np.abs(bits.mean(axis=0) - 0.5), kind="stable")
        self.width = radius.bit_length() + 1

    def within(self, values: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(i, j) where member j, in the packed bit set live, differs from values[i] in at most radius bits."""
        at = np.flatnonzero(live)
        mask = live[at]
        shape = (len(values), len(at))
        digits = [np.zeros(shape, np.uint64) for _ in range(self.width)]
        over = np.zeros(shape, np.uint64)
        for step, plane in enumerate(self.order, 1):
            flip = np.where((values >> np.uint64(plane)) & np.uint64(1), ~np.uint64(0), np.uint64(0))
            carry = self.planes[plane][at][None, :] ^ flip[:, None]
            for k in range(self.width):
                digits[k], carry = digits[k] ^ carry, digits[k] & carry
            over |= carry
            if step % 8 == 0:
                keep = (mask & ~self._beyond(digits, over)).any(axis=0)
                if not keep.any():
                    return np.empty(0, np.int64), np.empty(0, np.int64)
                if keep.sum() < 0.8 * len(keep):
                    at, mask, over = at[keep], mask[keep], over[:, keep]
                    digits = [d[:, keep] for d in digits]
        near = mask & ~self._beyond(digits, over)
        row, col = np.nonzero(near)
        bits = np.unpackbits(np.ascontiguousarray(near[row, col]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        hit, bit = np.nonzero(bits)
        return row[hit], at[col[hit]] * 64 + bit

    def _beyond(self, digits: list[np.ndarray], over: np.ndarray) -> np.ndarray:
        """Members whose counter exceeds the radius: a bitwise comparison from the top digit down."""
        above, equal = over.copy(), ~over
        for k in range(self.width - 1, -1, -1):
            if (self.radius >> k) & 1:
                equal &= digits[k]
            else:
                above |= equal & digits[k]
                equal &= ~digits[k]
        return above


def near_lanes(differ: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Whether each value of differ (a XOR of two fingerprints) has at most radius bits: one lane a comparison, bit-sliced."""
    _, near = BitPlanes(differ, radius).within(np.zeros(1, np.uint64), bit_set(len(differ)))
    out = np.zeros(len(differ), bool)
    out[near] = True
    return out


def bit_set(n: int) -> np.ndarray:
    """The first n bits set, packed 64 to a word."""
    return np.packbits(np.pad(np.ones(n, np.uint8), (0, -n % 64)), bitorder="little").view("<u8").copy()


def forest(n: int, pairs: np.ndarray) -> list[int]:
    """Rows of pairs (indices under n) that a spanning forest needs."""
    parent, kept = list(range(n)), []
    for row, (a, b) in enumerate(pairs.tolist()):
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        while parent[b] != b:
            parent[b] = b = parent[parent[b]]
        if a != b:
            parent[b] = a
            kept.append(row)
    return kept


def small_links(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Spanning links of many buckets of at most SMALL members: their comparisons share the lanes of the same bit planes."""
    lefts, rights = [], []
    for size in np.unique(sizes):
        a, b = np.triu_indices(size, 1)
        at = starts[sizes == size][:, None]
        lefts.append((at + a).ravel())
        rights.append((at + b).ravel())
    pairs = np.stack([np.concatenate(lefts), np.concatenate(rights)], axis=1) if lefts else np.empty((0, 2), np.int64)
    if not len(pairs):
        return np.empty((0, 2), np.uint64)
    found = [pairs[at : at + _LANES][near_lanes(values[pairs[at : at + _LANES, 0]] ^ values[pairs[at : at + _LANES, 1]], radius)] for at in range(0, len(pairs), _LANES)]
    pairs = np.concatenate(found)
    return values[pairs[forest(len(values), pairs)]] if len(pairs) else np.empty((0, 2), np.uint64)


def large_links(values: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Spanning links of one bucket: batches of pivots sweep the members that neither were pivots nor belong to the batch's component."""
    planes = BitPlanes(values, radius)
    #: waiting: members that were no pivots yet; owner: the component of members reached, else -1.
    waiting, owner = np.ones(len(values), bool), np.full(len(values), -1)
    found = [np.empty((0, 2), np.uint64)]
    while waiting.any():
        queued = np.flatnonzero(waiting & (owner >= 0))
        seen, alone = waiting, False
        if len(queued):
            counts = np.bincount(owner[queued])
            top = int(counts.argmax())
            # A large component's members needn't see each other; small ones share a batch and see everyone who waits.
            if alone := bool(counts[top] > _PIVOTS):
                queued = queued[owner[queued] == top]
                seen = waiting & (owner != top)
                if not seen.any():
                    break
            pivots = queued[:_PIVOTS]
        else:
            pivots = np.flatnonzero(waiting)[:_PIVOTS]
            owner[pivots] = pivots
        waiting[pivots] = False
        row, right = planes.within(values[pivots], np.packbits(np.pad(seen & waiting, (0, -len(values) % 64)), bitorder="little").view("<u8"))
        left = pivots[row]
        if not alone:
            i, j = np.triu_indices(len(pivots), 1)
            near = near_lanes(values[pivots[i]] ^ values[pivots[j]], radius) if len(i) else np.empty(0, bool)
            left, right = np.append(left, pivots[i[near]]), np.append(right, pivots[j[near]])
        fresh = np.flatnonzero(owner[right] < 0)
        reached, at = np.unique(right[fresh], return_index=True)
        owner[reached] = owner[left[fresh[at]]]
        found.append(np.stack([values[left[fresh[at]]], values[reached]], axis=1))
        apart = np.flatnonzero(owner[left] != owner[right])
        for k in apart.tolist():
            a, b = owner[left[k]], owner[right[k]]
            if a != b:
                owner[owner == b] = a
                found.append(values[[[left[k], right[k]]]])
    return np.concatenate(found)


def spanning_links(values: np.ndarray, cuts: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Spanning links of the buckets values[cuts[i]:cuts[i + 1]], as an n by 2 array of values."""
    sizes = np.diff(cuts)
    few = (sizes > 1) & (sizes <= SMALL)
    parts = [small_links(values, cuts[:-1][few], sizes[few], radius)]
    parts += [large_links(values[cuts[k] : cuts[k + 1]], radius) for k in np.flatnonzero(sizes > SMALL)]
    return np.concatenate(parts)


def bucket_links(fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(a, b): links between distinct fingerprints of column fp that connect all that lie within the radius."""
    if not radius < blocks <= 16:
        raise ValueError("blocks must be over the radius and at most 16")
    edges = [64 * k // blocks for k in range(blocks + 1)]
    masks = [((1 << edges[k + 1]) - 1) ^ ((1 << edges[k]) - 1) for k in range(blocks)]
    keys = []
    for number, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(masks[k] for k in chosen)
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.struct(F.lit(number).alias("way"), F.col("fp").bitwiseAND(F.lit(signed)).alias("key")))
    members = fps.select("fp", F.inline(F.array(*keys)).alias("way", "key"))
    # Written before members are joined with them: only a join whose sides are both dealt for it lets Spark split a hot bucket's task.
    sizes = cut(members.groupBy("way", "key").agg(F.count("*").alias("n")).where("n > 1"))
    members = members.join(sizes, ["way", "key"])
    #: A member of a bucket of t tiles goes to the t pairs of tiles that its own tile is part of.
    tiles = F.ceil(F.col("n") / F.lit(bucket_rows)).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    spread = (
        members.withColumn("tiles", tiles)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select("way", "key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fp")
    )

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["way", "key", "lo", "hi"]
        held: pd.DataFrame | None = None
        for frame in frames:
            frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
            marks = frame[names].to_numpy()
            new = np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1
            last = int(new[-1]) if len(new) else 0
            held = frame.iloc[last:]
            yield links_of(frame["fp"].to_numpy()[:last], [0, *new.tolist()])
        if held is not None and len(held):
            yield links_of(held["fp"].to_numpy(), [0, len(held)])

    def links_of(values: np.ndarray, cuts: list[int]) -> pd.DataFrame:
        pairs = np.ascontiguousarray(spanning_links(values.view(np.uint64), np.array(cuts), radius)).view(np.int64)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    # Sorted runs of equal keys stand for groups, so one Python call serves thousands of small buckets.
    dealt = spread.repartition("way", "key", "lo", "hi").sortWithinPartitions("way", "key", "lo", "hi")
    return dealt.mapInPandas(compare, "a long, b long").distinct()


def components(links: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(node, root): the smallest node reachable over the undirected links (a, b), for each node that has a link.

    Alternates large-star and small-star contraction.  Each round replaces a
    node's neighbours by an aggregated minimum and never gathers them.  Minima
    are combined before they are dealt, and written before edges are joined with
    them, so that Spark can split the join of a hub with very many edges.  Raises
    if max_rounds do not suffice.
    """
    # Tables, not checkpoints: those would hand on Spark's estimates of size, which every join squares.
    with scratch(links.sparkSession) as outlive:
        edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
        seen = None
        for _ in range(max_rounds):
            both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            lows = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low")))
            large = both.join(lows, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
            large = cut(large.where("u != v").distinct())
            joined = large.join(cut(large.groupBy("u").agg(F.min("v").alias("low"))), "u")
            small = joined.select("u", F.col("low").alias("v")).union(joined.select(F.col("v").alias("u"), F.col("low").alias("v")))
            edges = cut(small.where("u != v").distinct())
            now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if now == seen:
                roots = edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
                return outlive(roots.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()))
            seen = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE, blocks: int = BLOCKS) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs; component_id is the smallest doc_id reachable over links."""
    with scratch(docs.sparkSession) as outlive:
        fps = cut(fingerprints(docs, id_col, text_col, shingle))
        classes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
        roots = components(bucket_links(classes.select("fp"), radius, blocks)).withColumnRenamed("node", "fp")
        return outlive(fps.join(named_classes(classes, roots), "fp").select("doc_id", "fp", F.col("first").alias("component_id")))


def named_classes(classes: DataFrame, roots: DataFrame) -> DataFrame:
    """(fp, first): the smallest first of all classes (fp, first) that share a root (fp, root); classes without a root stand alone."""
    rooted = cut(classes.select("fp", "first").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    return rooted.select("fp", "root").join(cut(rooted.groupBy("root").agg(F.min("first").alias("first"))), "root").select("fp", "first")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_sets(texts: Iterable[str | None], shingle: int = STAGE_SHINGLE) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's word shingles; none for a text without words."""
    out: list[np.ndarray] = []
    lines, chars = [], 0

    def flush() -> None:
        full = [x for x in lines if x]
        windows, hashes = _shingle_hashes(full, shingle) if full else (np.empty(0, np.int64), np.empty(0, np.uint64))
        parts = iter(np.split(hashes, np.cumsum(windows)[:-1]))
        out.extend(np.unique(next(parts)) if x else np.empty(0, np.uint64) for x in lines)

    for text in texts:
        lines.append(b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split()))
        chars += len(lines[-1])
        if chars >= _CHARS:
            flush()
            lines, chars = [], 0
    flush()
    return out


def set_digest(shingles: np.ndarray) -> int:
    """A signed 64-bit digest of a set of shingles, zero for the empty one."""
    return int(np.array([xxhash.xxh64_intdigest(shingles.tobytes(), SEED)], np.uint64).view(np.int64)[0]) if len(shingles) else 0


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """One row of BANDS signed keys for each set, none of them empty: each the hash of BAND_ROWS minima."""
    rng = np.random.default_rng(SEED)
    odd, noise = rng.integers(0, 1 << 64, (2, BANDS * BAND_ROWS), np.uint64, endpoint=False)
    out = np.zeros((len(sets), BANDS), np.uint64)
    for low, high in _runs(sets):
        data = np.concatenate(sets[low:high])
        cuts = np.cumsum([0, *map(len, sets[low : high - 1])])
        for k in range(BANDS * BAND_ROWS):
            least = np.minimum.reduceat((data ^ noise[k]) * (odd[k] | np.uint64(1)), cuts)
            out[low:high, k // BAND_ROWS] = _mixed(out[low:high, k // BAND_ROWS] ^ least)
    return out.view(np.int64)


def _runs(sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Ranges of sets of about 2^15 shingles, which stay in a core's cache."""
    low = total = 0
    for k, x in enumerate(sets):
        total += len(x)
        if total >= 1 << 15:
            yield low, k + 1
            low, total = k + 1, 0
    if low < len(sets):
        yield low, len(sets)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def similar_links(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Spanning links of the sets whose exact Jaccard similarity is SIMILAR or more; one component is swept at a time."""
    top, bottom = SIMILAR
    sizes = np.array([len(x) for x in sets])
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(codes), np.uint8)
    starts = np.cumsum(sizes) - sizes
    live = np.arange(len(sets))
    found: list[tuple[int, int]] = []
    queue: list[int] = []
    held = None
    while len(live):
        if not queue:
            queue, live, held = [int(live[0])], live[1:], None
        at = queue.pop()
        if not len(live):
            break
        if held is None:
            held = np.concatenate([codes[starts[k] : starts[k] + sizes[k]] for k in live])
        own = codes[starts[at] : starts[at] + sizes[at]]
        mark[own] = 1
        shared = np.add.reduceat(mark[held], np.cumsum(sizes[live]) - sizes[live], dtype=np.int64)
        mark[own] = 0
        near = bottom * shared >= top * (sizes[live] + sizes[at] - shared)
        if near.any():
            found += [(at, int(k)) for k in live[near]]
            queue += live[near].tolist()
            live, held = live[~near], None
    return found


def set_fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """The signed SimHash of each set of shingles, none of them empty, in parts of about _CHARS shingles."""
    sizes = np.array([len(x) for x in sets], np.int64)
    part = np.cumsum(sizes) // _CHARS
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sets)]
    found = [_majority(sizes[a:b], np.concatenate(sets[a:b])) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
    return np.concatenate([np.empty(0, np.uint64), *found]).view(np.int64)


def shingled(docs: DataFrame) -> DataFrame:
    """(d, fp, sim, bands, row) for each row of docs: the row whole, its set's digest, SimHash (null if empty) and band keys, and a number
    that is stable once this is written."""

    def of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sets = shingle_sets(batch.column("d").field("text").to_pylist())
        full = [k for k, x in enumerate(sets) if len(x)]
        bands: list = [[]] * len(sets)
        sims: list = [None] * len(sets)
        chosen = [sets[k] for k in full]
        for k, own, sim in zip(full, band_keys(chosen), set_fingerprints(chosen).tolist(), strict=True):
            bands[k], sims[k] = own, sim
        digests = pa.array([set_digest(x) for x in sets], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("d"), digests, pa.array(sims, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], names=["d", "fp", "sim", "bands"])

    schema = T.StructType([T.StructField("d", docs.schema, False), T.StructField("fp", T.LongType()), T.StructField("sim", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])
    return arrow_map(rows_of(docs).select("d"), of, schema).withColumn("row", F.monotonically_increasing_id())


def fingerprint_links(classes: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(a, b): links between the classes (fp, sim) whose SimHashes sim lie within the radius: each class with the first of its SimHash, and the firsts of
    linked SimHashes."""
    firsts = cut(classes.where("sim is not null").groupBy("sim").agg(F.min("fp").alias("low")))
    equal = classes.select("fp", "sim").join(firsts, "sim").where("fp != low").select(F.col("fp").alias("a"), F.col("low").alias("b"))
    near = bucket_links(firsts.select(F.col("sim").alias("fp")), radius, blocks)
    named = near.join(firsts.select(F.col("sim").alias("a"), F.col("low").alias("left")), "a").join(firsts.select(F.col("sim").alias("b"), F.col("low").alias("right")), "b")
    return equal.union(named.select(F.col("left").alias("a"), F.col("right").alias("b")))


def band_marks(bands: str) -> Column:
    """The band keys as one array of longs: the band's number above KEY_BITS bits of its key, so that a shuffle carries one value and few random bytes.
    Keys that agree in these bits alone add candidates, never links."""
    low = F.lit((1 << KEY_BITS) - 1)
    return F.transform(bands, lambda key, way: F.shiftleft(way.cast("long"), KEY_BITS).bitwiseOR(key.bitwiseAND(low)))


def similar_rows(rows: DataFrame, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(row, doc_id, component_id, keeper) for written rows of shingled(): component_id is the smallest doc_id reachable over pairs of
    Jaccard similarity SIMILAR or more, keeper the number of its first row; rows without an id come last.

    SimHash links (fingerprint_links) and MinHash bands only say who is compared: components
    of documents that either connects are compared pair by pair, in tiles of member ranges, by the exact sets.
    A pair at 0.8 that no fingerprints link shares no band with a chance of 1 in 20,000, at 0.85 of 1 in 2,000,000,
    and may still be compared through others.  Equal sets are one row, empty ones equal.
    Texts are read once more; only those of classes that have a partner are dealt, all others stay where they are.
    """

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["root", "lo", "hi"]
        held: pd.DataFrame | None = None
        for frame in frames:
            frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
            marks = frame[names].to_numpy()
            cuts = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1).tolist()]
            held = frame.iloc[cuts[-1] :]
            yield links_of(frame.iloc[: cuts[-1]], cuts)
        if held is not None:
            yield links_of(held, [0, len(held)])

    def links_of(frame: pd.DataFrame, cuts: list[int]) -> pd.DataFrame:
        sets, fps = shingle_sets(frame["text"]), frame["fp"].to_numpy()
        links = [(fps[a + i], fps[a + j]) for a, b in zip(cuts, cuts[1:], strict=False) if b - a > 1 for i, j in similar_links(sets[a:b])]
        return pd.DataFrame(np.array(links, np.int64).reshape(-1, 2), columns=["a", "b"])

    with scratch(rows.sparkSession) as outlive:
        doc_id = F.col("d.doc_id").cast("long")
        first = F.min(F.struct(doc_id.isNull().alias("none"), doc_id.alias("doc_id"), "row"))
        classes = cut(rows.groupBy("fp").agg(first.alias("first"), F.min("sim").alias("sim")))
        # A class goes by the number of its first row: within a task's rows numbers differ in few bytes, so shuffles compress them well.
        numbers = cut(classes.select(F.col("first.row").alias("row"), "fp", "sim"))
        members = flagged(rows.select("row", "bands"), numbers).where("hit").select("row", F.explode(band_marks("bands")).alias("key"))
        # As everywhere here, what rows are joined with is written first, so that Spark can split a hot key's join.
        lows = cut(members.groupBy("key").agg(F.min("row").alias("low"), F.max("row").alias("high")).where("low < high").select("key", "low"))
        shared = members.join(lows, "key").where("row != low").select(F.col("row").alias("a"), F.col("low").alias("b"))
        groups = cut(components(shared.union(fingerprint_links(numbers.select(F.col("row").alias("fp"), "sim")))).withColumnRenamed("node", "row"))
        groups = cut(groups.join(cut(groups.groupBy("root").agg(F.count("*").alias("n"))), "root").join(numbers.select("row", "fp"), "row"))
        tiles = F.ceil(F.col("n") / F.lit(tile_rows)).cast("int")
        texts = flagged(rows.select("row", F.col("d.text").alias("text")), groups.select("row")).where("hit").select("row", "text")
        spread = (
            groups.withColumn("tiles", tiles)
            .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
            .join(texts, "row")
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
            .select("root", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fp", "text")
        )
        dealt = text_batches(spread.repartition("root", "lo", "hi").sortWithinPartitions("root", "lo", "hi"))
        roots = components(dealt.mapInPandas(compare, "a long, b long")).withColumnRenamed("node", "fp")
        found = rows.select("row", doc_id.alias("doc_id"), "fp").join(named_classes(classes, roots), "fp")
        return outlive(found.select("row", "doc_id", F.col("first.doc_id").alias("component_id"), F.col("first.row").alias("keeper")))


def jaccard_duplicates(docs: DataFrame, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(doc_id, component_id) for each row of docs."""
    with scratch(docs.sparkSession) as outlive:
        return outlive(similar_rows(cut(shingled(docs)), tile_rows).select("doc_id", "component_id"))


def keep_first(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component of rows with five-word Jaccard similarity 0.8 or more one row stays, that with the smallest id
    (of rows with one id, or none, any single one).  Rows of one id and unlike texts both stay.  The rows, written once, are read again
    by the result, so their table lasts until the caller's scratch() ends."""
    rows, _ = written(shingled(docs))
    gone = similar_rows(rows).where("row != keeper").select("row")
    return whole(flagged(rows.select("d", "row"), gone).where("not hit"), docs)
