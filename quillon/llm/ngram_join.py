"""Exact Jaccard join of documents on word n-grams, as a blocked sparse matrix product.

Rows of the incidence matrix are documents, columns their distinct five-word
shingles, and a pair links when 100 * overlap >= 80 * union.  The product of the
matrix with its own transpose holds all overlaps; size-derived bounds keep it
from being computed where no pair can link:

1. equal sets are one row of the matrix (a class), named by a 128-bit digest, so
   exact copies cost nothing further;
2. a linked pair shares at least 0.8 of either set.  With columns in one order for all,
   it shares one among each set's first n - ceil(0.8 n) + 1 columns.  Only these enter
   the first product.  Frequent columns come last, by counts of all shingles in
   SLOTS hashed counters (a table of fixed size; any order gives right results,
   a good one gives few candidates);
3. column blocks are dealt by hash.  Within a column, sizes and places of its rows
   bound a pair's overlap: the set sizes from above by what is left after the shared
   column.  Pairs below 80 per cent are dropped there.  A column links its rows with its
   most central one first (the one with fewest rarer shingles), so that a group of n
   near copies costs n comparisons, not n * n.  Columns that hold over 1 / HOT_SHARE of
   all documents are dealt in SALTS parts, whose central rows give the column's own;
4. row blocks of candidates hold one row and up to BLOCK_ROWS partners.  Their overlaps
   are accumulated over blocks of columns of the whole sets; a pair is
   discarded once its overlap and what is left of the smaller set cannot reach the bound;
5. the classes linked so far are components.  Columns whose rows still lie in
   several components compare the rest, all pairs of unlike components within the bounds, in tiles.
   No link between different components is lost; links inside one need not be found;
6. components follow by hub contraction of links alone.

Texts are read three times: to count, to choose columns, and (only texts with a
candidate, found by a Bloom filter of fixed size) to compare.  Shingles are
compared as 64-bit hashes.

Defined cases: null and empty texts, and texts without words, have no shingles
and link with nothing, not even with each other; a text with fewer words than a
shingle is one shingle; a row with a null doc_id never names a component, which
is null if it has no other rows; repeated rows share one; texts are whole,
however long; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import cut, scratch, table, text_batches, written
from quillon.llm.simhash import components, shingle_sets

SHINGLE = 5
#: The least similarity as a fraction.
SIMILAR = (4, 5)
#: Hashed counters of shingles, one byte each once summed, and rows that a task's counters travel in.
SLOTS, CHUNKS = 1 << 20, 64
#: Bits of the filter that picks texts with candidates.
BLOOM_BITS = 1 << 23
#: A column is dealt in SALTS parts where its counter holds over 1 / HOT_SHARE of the documents.
HOT_SHARE, SALTS = 256, 16
BLOCK_ROWS = 64
TILE_ROWS = 2048
#: Columns of a set that are added up before pairs are discarded.
COLUMN_BLOCK = 4096


def digest(shingles: np.ndarray) -> bytes:
    return xxhash.xxh128_digest(shingles.tobytes()) if len(shingles) else b""


def class_number(name: bytes) -> int:
    """A signed 64-bit number of a class for the search of candidates; two classes that share one are both compared."""
    return int.from_bytes(name[:8], "little", signed=True)


def prefix_size(n: int) -> int:
    """How many columns of a set of n are sure to hold one shared with any partner."""
    top, bottom = SIMILAR
    return n - -(-top * n // bottom) + 1


def least_overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest overlap with which sets of sizes a and b link: overlap * bottom >= top * (a + b - overlap)."""
    top, bottom = SIMILAR
    return -(-top * (a + b) // (top + bottom))


def slot(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(44)).astype(np.int64) & (SLOTS - 1)


def described(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, np.ndarray, int]:
    """(doc_id, text_key, name, n, c) for each row of docs, written; the levels of all shingle counters; and the number of documents."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = np.zeros(SLOTS, np.int64), set()
        for batch in batches:
            sets = shingle_sets(batch.column("text").to_pylist(), SHINGLE)
            names = [digest(x) for x in sets]
            # A task counts the shingles of a class once, however many copies it has.
            fresh = [k for k, name in enumerate(names) if name and name not in seen and not seen.add(name)]
            if fresh:
                np.add.at(counts, slot(np.concatenate([sets[k] for k in fresh])), 1)
            yield batch_of(batch.column("doc_id"), batch.column("text_key"), names, [len(x) for x in sets], [class_number(x) for x in names])
        for k, part in enumerate(np.split(counts, CHUNKS)):
            yield batch_of([None], [k], [part.astype("<u4").tobytes()], [-1], [0])

    def batch_of(*columns: object) -> pa.RecordBatch:
        types = (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64())
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "text_key", "name", "n", "c"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    found, _ = written(text_batches(source).mapInArrow(of, "doc_id long, text_key long, name binary, n int, c long"))
    rows = found.where("n >= 0")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, part in zip(batch.column("text_key").to_pylist(), batch.column("name").to_pylist(), strict=True):
                own = np.frombuffer(part, "<u4").astype(np.int64)
                total[k] = total[k] + own if k in total else own
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["k", "counts"])

    parts = found.where("n < 0").select("text_key", "name").repartition("text_key").mapInArrow(summed, "k long, counts binary").collect()
    counts = np.zeros((CHUNKS, SLOTS // CHUNKS), np.int64)
    for row in parts:
        counts[row.k] = np.frombuffer(row.counts, np.int64)
    return rows, counts.ravel(), rows.count()


def levels(counts: np.ndarray) -> np.ndarray:
    """Counters as bytes, four steps to a doubling: enough to order columns by."""
    return np.floor(4 * np.log2(counts + 1.0)).astype(np.uint8)


def entries(docs: DataFrame, order: np.ndarray, hot: np.ndarray, text_col: str = "text") -> DataFrame:
    """(key, salt, c, n, place): the leading columns of each class of docs; a task gives those of a class once."""
    context = docs.sparkSession.sparkContext
    shared = context.broadcast((order, hot))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, hot = shared.value
        seen: set[bytes] = set()
        for batch in batches:
            keys, cs, ns, places = [], [], [], []
            for own in shingle_sets(batch.column(0).to_pylist(), SHINGLE):
                name = digest(own)
                if not name or name in seen:
                    continue
                seen.add(name)
                k = prefix_size(len(own))
                # Sets come sorted by hash; a stable sort by level makes the order (level, hash).
                level = order[slot(own)]
                if k < len(own):
                    bar = np.partition(level, k - 1)[k - 1]
                    low = np.flatnonzero(level < bar)
                    low = low[np.argsort(level[low], kind="stable")]
                    first = own[np.append(low, np.flatnonzero(level == bar)[: k - len(low)])]
                else:
                    first = own[np.argsort(level, kind="stable")]
                keys.append(first)
                cs.append(np.full(k, class_number(name), np.int64))
                ns.append(np.full(k, len(own), np.int32))
                places.append(np.arange(k, dtype=np.int32))
            if keys:
                key, c = np.concatenate(keys), np.concatenate(cs)
                salt = np.where(hot[slot(key)], 1 + c % SALTS, 0).astype(np.int16)
                columns = [key.view(np.int64), salt, c, np.concatenate(ns), np.concatenate(places)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["key", "salt", "c", "n", "place"])

    return text_batches(docs.select(text_col)).mapInArrow(of, "key long, salt short, c long, n int, place int")


def may_link(n: np.ndarray, place: np.ndarray, m: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether sets of sizes n and m can link when a column at these places is the first that they share."""
    return 1 + np.minimum(n - place, m - other) - 1 >= least_overlap(n, m)


_MEMBERS = pa.schema([("kind", pa.int8()), ("key", pa.int64()), ("c", pa.int64()), ("n", pa.int32()), ("place", pa.int32()), ("other", pa.int64())])
#: Kinds of rows: a pair of candidates (c, other), a row of a column with several, and of a column in parts a row and a part's central row.
PAIR, MEMBER, PARTED, CENTRE = range(4)


def central_pairs(dealt: DataFrame) -> DataFrame:
    """Rows of all kinds from entries (key, salt, c, n, place): each column's rows meet its most central one.

    A column streams by; all that is held is its central row, so it may be of any length.  MEMBER rows are those of columns in which
    pairs without the central row are possible, over two rows.
    """
    names = ("key", "salt", "c", "n", "place")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            own = [batch.column(x).to_numpy() for x in names]
            if held is not None:
                # The last column's central row goes before what may be more of its rows.
                own = [np.append(h, x) for h, x in zip(held, own, strict=True)]
            key, salt, c, n, place = own
            if not len(key):
                continue
            new = np.append(True, (key[1:] != key[:-1]) | (salt[1:] != salt[:-1]))
            heads, run = np.flatnonzero(new), np.cumsum(new) - 1
            parted, hub, m, other = salt > 0, c[heads][run], n[heads][run], place[heads][run]
            follows = c != hub
            near = follows & ~parted & may_link(n, place, m, other)
            pairs = np.unique(np.stack([hub[near], c[near]], axis=1), axis=0)
            yield rows_of(PAIR, pairs[:, 0] * 0, pairs[:, 0], pairs[:, 0] * 0, pairs[:, 0] * 0, pairs[:, 1])
            size = np.bincount(run, weights=follows)
            wide = size > 1
            # A column may go on in the next batch, or have begun in the last one.
            wide[[0, -1]] |= (size > 0)[[0, -1]]
            for kind, on in ((MEMBER, wide[run] & ~parted), (PARTED, parted), (CENTRE, parted & new)):
                yield rows_of(kind, key[on], c[on], n[on], place[on], hub[on])
            held = [x[heads[-1:]] for x in own]

    def rows_of(kind: int, *values: np.ndarray) -> pa.RecordBatch:
        columns = (np.full(len(values[0]), kind), *values)
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, _MEMBERS, strict=True)], schema=_MEMBERS)

    ordered = dealt.repartition("key", "salt").sortWithinPartitions("key", "salt", "place", "n", "c")
    return ordered.mapInArrow(of, "kind byte, key long, c long, n int, place int, other long")


def parted_pairs(found: DataFrame) -> DataFrame:
    """(c, other): rows of the columns dealt in parts beside their column's central row, within the bounds."""
    top, bottom = SIMILAR
    best = F.min(F.struct("place", "n", "c"))
    # Few rows, written before columns are joined with them, so that Spark can split a hot column's join.
    centres = cut(found.where(F.col("kind") == CENTRE).groupBy("key").agg(best.alias("best")).select("key", F.col("best.c").alias("hub"), F.col("best.n").alias("m"), F.col("best.place").alias("at")))
    rows = found.where(F.col("kind") == PARTED).select("key", "c", "n", "place").join(centres, "key").where("c != hub")
    bound = F.least(F.col("n") - F.col("place"), F.col("m") - F.col("at")) * (top + bottom) >= (F.col("n") + F.col("m")) * top
    return rows.where(bound).select("c", F.col("hub").alias("other"))


def open_pairs(members: DataFrame, placed: DataFrame) -> DataFrame:
    """(a, b): all pairs within the bounds of rows (key, c, n, place) whose components, in placed (c, root), differ."""
    rows = cut(members.join(placed, "c").select("key", "c", "n", "place", "root").distinct())
    columns = cut(rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("size")).where("low != high").select("key", "size"))
    tiles = F.ceil(F.col("size") / F.lit(TILE_ROWS)).cast("int")
    spread = (
        rows.join(columns, "key")
        .withColumn("tiles", tiles)
        .withColumn("own", F.pmod(F.xxhash64("c"), F.col("tiles")).cast("int"))
        .withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select("key", F.least("own", "tile").alias("lo"), F.greatest("own", "tile").alias("hi"), "own", "c", "n", "place", F.xxhash64("root").alias("root"))
    )

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            marks = np.stack([rows.column(x).to_numpy() for x in ("key", "lo", "hi")])
            cuts = np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1
            last = int(cuts[-1]) if len(cuts) else 0
            held = rows.slice(last)
            yield from pairs(rows.slice(0, last), [0, *cuts.tolist()])
        if held is not None:
            yield from pairs(held, [0, held.num_rows])

    def pairs(rows: pa.Table, cuts: list[int]) -> Iterator[pa.RecordBatch]:
        lo, hi, own, c, n, place, root = (rows.column(x).to_numpy() for x in ("lo", "hi", "own", "c", "n", "place", "root"))
        for low, high in zip(cuts, cuts[1:], strict=False):
            at = np.arange(low, high)
            # Rows of tile lo meet those of tile hi, each pair once.
            for k in range(low, high):
                if own[k] != lo[k]:
                    continue
                others = at[k + 1 - low :] if lo[k] == hi[k] else at[own[low:high] == hi[k]]
                keep = (root[others] != root[k]) & may_link(n[others], place[others], n[k], place[k])
                found = c[others[keep]]
                if len(found):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(found, c[k])), pa.array(np.maximum(found, c[k]))], names=["a", "b"])

    dealt = spread.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return dealt.mapInArrow(of, "a long, b long").distinct()


def overlaps(row: np.ndarray, partners: list[np.ndarray]) -> np.ndarray:
    """Whether each partner's set links with row's: one row of the sparse product, accumulated over blocks of columns.

    All sets are sorted, so a block of columns is a range of each.  After a block, a partner whose overlap so far and what both sets
    have left cannot reach the bound is discarded.
    """
    sizes = np.array([len(x) for x in partners])
    need = least_overlap(sizes, len(row))
    live = np.flatnonzero(need <= np.minimum(sizes, len(row)))
    total, used = np.zeros(len(partners), np.int64), np.zeros(len(partners), np.int64)
    for low in range(0, len(row), COLUMN_BLOCK):
        if not len(live):
            break
        block = row[low : low + COLUMN_BLOCK]
        rest = len(row) - low - len(block)
        until = [len(partners[k]) if not rest else int(np.searchsorted(partners[k], block[-1], "right")) for k in live]
        columns = np.concatenate([partners[k][used[k] : u] for k, u in zip(live, until, strict=True)])
        at = np.searchsorted(block, columns).clip(max=len(block) - 1)
        lengths = np.array(until) - used[live]
        ends = np.append(0, np.cumsum(block[at] == columns))[np.append(0, np.cumsum(lengths))]
        total[live] += np.diff(ends)
        used[live] = until
        live = live[total[live] + np.minimum(rest, sizes[live] - used[live]) >= need[live]]
    out = np.zeros(len(partners), bool)
    out[live] = total[live] >= need[live]
    return out


def verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, text_col: str = "text") -> DataFrame:
    """(a, b), names of classes: those candidate pairs (a, b) of class numbers that link, by their whole sets."""
    ends = classes.select("c", "name", "text_key")
    left, right = ends.toDF("a", "a_name", "a_key"), ends.toDF("b", "b_name", "b_key")
    named = cut(pairs.join(left, "a").join(right, "b").select("a_name", "a_key", "b_name", "b_key"))
    # The end with more pairs is its block's row, so that a group's centre is read once a block.
    both = named.select(F.col("a_name").alias("name")).union(named.select(F.col("b_name").alias("name")))
    counts = cut(both.groupBy("name").agg(F.count("*").alias("pairs")))
    sized = named.join(counts.toDF("a_name", "a_pairs"), "a_name").join(counts.toDF("b_name", "b_pairs"), "b_name")
    swap = F.col("b_pairs") > F.col("a_pairs")
    pick = [F.when(swap, F.col(f"b_{x}")).otherwise(F.col(f"a_{x}")).alias(f"row_{x}") for x in ("name", "key", "pairs")]
    pick += [F.when(swap, F.col(f"a_{x}")).otherwise(F.col(f"b_{x}")).alias(f"other_{x}") for x in ("name", "key")]
    blocks = F.ceil(F.col("row_pairs") / F.lit(BLOCK_ROWS)).cast("int")
    dealt = sized.select(*pick).withColumn("block", F.pmod(F.xxhash64("other_name"), blocks).cast("int"))
    part = dealt.select("row_name", "block", F.lit(1).alias("role"), F.col("other_name").alias("name"), F.col("other_key").alias("text_key"))
    heads = dealt.select("row_name", "block", F.lit(0).alias("role"), F.col("row_name").alias("name"), F.col("row_key").alias("text_key")).distinct()
    wanted = cut(part.union(heads))
    rows = wanted.join(candidate_texts(docs, wanted, text_col), "text_key").select("row_name", "block", "role", "name", "text")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, row, name = None, None, b""
        for batch in batches:
            keys = list(zip(batch.column("row_name").to_pylist(), batch.column("block").to_pylist(), strict=True))
            role, names = batch.column("role").to_pylist(), batch.column("name").to_pylist()
            sets = shingle_sets(batch.column("text").to_pylist(), SHINGLE)
            linked: list[tuple[bytes, bytes]] = []
            low = 0
            while low < len(keys):
                high = low
                while high < len(keys) and keys[high] == keys[low]:
                    high += 1
                if keys[low] != at:
                    at, row = keys[low], None
                # A text whose key another text shares is not the class's own.
                own = [k for k in range(low, high) if digest(sets[k]) == names[k]]
                for k in own:
                    if role[k] == 0:
                        row, name = sets[k], names[k]
                others = [k for k in own if role[k]]
                if row is not None and others:
                    linked += [(name, names[k]) for k, near in zip(others, overlaps(row, [sets[k] for k in others]), strict=True) if near]
                low = high
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in linked], pa.binary()) for i in (0, 1)], names=["a", "b"])

    blocks_of = text_batches(rows.repartition("row_name", "block").sortWithinPartitions("row_name", "block", "role"))
    return cut(blocks_of.mapInArrow(of, "a binary, b binary").distinct())


def candidate_texts(docs: DataFrame, wanted: DataFrame, text_col: str) -> DataFrame:
    """(text_key, text): each text of docs once whose key is in wanted; a Bloom filter of BLOOM_BITS lets through few others."""
    marks = wanted.select(F.pmod(F.col("text_key"), F.lit(BLOOM_BITS)).cast("int").alias("bit")).distinct()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BLOOM_BITS, np.uint8)
        for batch in batches:
            bits[batch.column(0).to_numpy()] = 1
        held = np.packbits(bits).reshape(CHUNKS, -1)
        used = np.flatnonzero(held.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([held[k].tobytes() for k in used], pa.binary())], names=["k", "bits"])

    filled = np.zeros((CHUNKS, BLOOM_BITS // 8 // CHUNKS), np.uint8)
    width = BLOOM_BITS // CHUNKS
    for row in marks.repartition(F.expr(f"bit div {width}")).mapInArrow(packed, "k int, bits binary").collect():
        filled[row.k] |= np.frombuffer(row.bits, np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(filled.ravel())

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = np.unpackbits(shared.value).astype(bool), set()
        for batch in batches:
            texts, rows = batch.column("text"), []
            for k in np.flatnonzero(bits[batch.column("text_key").to_numpy() % BLOOM_BITS]).tolist():
                # A task passes a text on once.
                mark = xxhash.xxh128_digest((texts[k].as_py() or "").encode("utf-8", "surrogatepass"))
                if mark not in seen:
                    seen.add(mark)
                    rows.append(k)
            yield batch.take(pa.array(rows, pa.int64()))

    source = docs.select(F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    return text_batches(source).mapInArrow(of, "text_key long, text string").dropDuplicates(["text_key", "text"])


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_key, name, n, c) for each row of docs, and (name, first) for each class with shingles: the smallest doc_id reachable over links.

    Call it inside scratch(), to whose end both last.
    """
    rows, counts, documents = described(docs, id_col, text_col)
    classes = cut(rows.where("n > 0").groupBy("name", "n").agg(F.min("doc_id").alias("first"), F.min("text_key").alias("text_key"), F.min("c").alias("c")))
    hot = counts > max(documents // HOT_SHARE, 1)
    found, _ = written(central_pairs(entries(docs, levels(counts), hot, text_col)))
    pairs = found.where(F.col("kind") == PAIR).select("c", "other").union(parted_pairs(found))
    pairs = pairs.select(F.least("c", "other").alias("a"), F.greatest("c", "other").alias("b")).distinct()
    candidates = cut(pairs)
    links = verified(docs, classes, candidates, text_col)
    roots = components(links)
    placed = cut(classes.join(roots.withColumnRenamed("node", "name"), "name", "left").select("name", "c", F.coalesce("root", "name").alias("root")))
    others = cut(open_pairs(found.where(F.col("kind").isin(MEMBER, PARTED)), placed).join(candidates, ["a", "b"], "left_anti"))
    more = None if others.isEmpty() else verified(docs, classes, others, text_col)
    if more is not None and not more.isEmpty():
        # Links between components: few, so that only their roots are contracted once more.
        left, right = placed.select(F.col("name").alias("a"), F.col("root").alias("ra")), placed.select(F.col("name").alias("b"), F.col("root").alias("rb"))
        joined = components(more.join(left, "a").join(right, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))).toDF("root", "joint")
        placed = cut(placed.join(joined, "root", "left").select("name", F.coalesce("joint", "root").alias("root")))
    ends = placed.join(classes.select("name", "first"), "name")
    lows = cut(ends.groupBy("root").agg(F.min("first").alias("first")))
    return rows, cut(placed.select("name", "root").join(lows, "root").select("name", "first"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs."""
    with scratch(docs.sparkSession) as outlive:
        rows, named = join(docs, id_col, text_col)
        found = rows.join(named, "name", "left")
        own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("first"))
        return outlive(found.select("doc_id", F.col("n").cast("long").alias("n_shingles"), own.alias("component_id")))


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
