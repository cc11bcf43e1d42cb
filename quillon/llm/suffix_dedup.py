"""Removal of repeated passages with a sparse suffix array.

Of all suffixes (in words) only those at minimiser positions are retained: in
every window of ``length`` words, the suffix whose first ``gram`` words have the
smallest hash, leftmost on ties.  The choice depends on the window's words
alone, so equal windows retain the same suffix, and about two suffixes in
``length - gram`` words stand for all.  A retained suffix stands for a run of
windows and carries the words that these cover, left and right of it.

1. Suffixes whose first words occur once are dropped (most are).  Those that
   agree in all the words their windows cover are one class; all members but
   the first repeat it.
2. One suffix of each class is put in order: dealt by the hash of the first
   words, then sorted by the words themselves.  Neighbours are compared word by
   word; so are neighbours in the order of the words before them.
3. Matches are extended both ways: the windows that start ``a`` words before two
   suffixes are equal if all neighbours between the two in the suffix order
   share ``length - a`` words, and all between them in the other order ``a``
   words.  So each suffix finds the first occurrence of each of its windows,
   however many others lie between.
4. A run of over ``run_rows`` classes with the same first words is too long for
   one task.  Its windows are dealt one by one, by a digest of their words, and
   combined as counts and minima before rows are joined with them.

A window of ``length`` words is a repeat if an equal one stands in a row of
smaller (doc_id, row number) or before it in its own; words that repeats cover
are removed, so the first occurrence of each passage stays.  The result is that
of comparing all windows, up to collisions of the 64-bit digests of steps 1 and 4.

Texts are read narrowly and written once with a number for each row; those of
rows that hold a class's first member are dealt once more, to give its words,
and those of rows with repeated words to be cut.  All others stay where they are.

Defined cases: null and empty texts and texts of under ``length`` words have no
windows and are kept whole; a passage repeated inside a row stays once; every row
is a document of its own, also where ids repeat; rows with a null doc_id come
last; of equal rows the first by number stays; a text of over 2**30 words would
need wider positions than a batch has; an empty table gives an empty result;
other columns are ignored by repeats() and kept by cut_stage(), whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import arrow_map, cut, flagged, rows_of, scratch, table, text_parts, written

LENGTH = 50
GRAM = 10
#: Classes of a run that one task puts in order; longer runs are dealt window by window.
RUN_ROWS = 256
_CHARS = 1_000_000
#: Bits of a position in a window's minimum; the rest hold the hash.
_AT = 30
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPANS = "array<struct<first:int,until:int>>"


def _powers(base: int) -> Iterator[np.ndarray]:
    """Powers of an odd base modulo 2**64, as many as are asked for by send()."""
    held = np.ones(1, np.uint64)
    n = yield held
    while True:
        while len(held) < n:
            held = np.concatenate([held, held * np.uint64(pow(base, len(held), 1 << 64))])
        n = yield held[:n]


class _Roller:
    """Hashes of spans of a sequence of uint64 from prefix sums: (sum of x[i] * b**i over the span) / b**start."""

    # Odd multipliers; any would do.
    BASE = 0x9E3779B97F4A7C15
    _up = _powers(BASE)
    _down = _powers(pow(BASE, -1, 1 << 64))
    next(_up), next(_down)

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * self._up.send(n), out=self.sums[1:])
        self.back = self._down.send(n + 1)

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.back[starts])


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of uint64."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_BYTES = mixed(np.arange(1, 257, dtype=np.uint64))


def word_roller(texts: Iterable[str | None]) -> tuple[_Roller, np.ndarray]:
    """Span hashes over the words of all texts in one row, and each text's first word (one more for the end)."""
    lines = [b" ".join((t or "").encode("utf-8", "surrogatepass").split()) for t in texts]
    sizes = np.array([x.count(b" ") + 1 if x else 0 for x in lines], np.int64)
    data = np.frombuffer(b" ".join(x for x in lines if x), np.uint8)
    ends = np.append(np.flatnonzero(data == 32), len(data))
    starts = np.append(0, ends[:-1] + 1)
    words = _Roller(_BYTES[data]).spans(starts, ends) if len(data) else np.empty(0, np.uint64)
    return _Roller(words), np.append(0, np.cumsum(sizes))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each window of the given width."""
    n = len(values) - width + 1
    padded = np.concatenate([values, np.full(-len(values) % width, ~np.uint64(0), np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def suffixes_of(texts: list[str | None], length: int = LENGTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """Retained suffixes: text (index), h (first words), ha (all words covered), first and last (window starts), lead (words from first to the suffix)."""
    roll, bounds = word_roller(texts)
    total = int(bounds[-1])
    none = np.empty(0, np.int64)
    if total < length:
        return dict.fromkeys(("text", "h", "ha", "first", "last", "lead"), none)
    at = np.arange(total - gram + 1)
    grams = roll.spans(at, at + gram)
    low = np.uint64((1 << _AT) - 1)
    least = sliding_min((grams & ~low) | at.astype(np.uint64), length - gram + 1)
    anchor = (least & low).astype(np.int64)
    start = np.arange(len(anchor))
    owner = np.searchsorted(bounds, start, side="right") - 1
    real = start + length <= bounds[owner + 1]
    start, anchor, owner = start[real], anchor[real], owner[real]
    if not len(start):
        return dict.fromkeys(("text", "h", "ha", "first", "last", "lead"), none)
    turn = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(owner) != 0))
    first, last = start[np.append(0, turn + 1)], start[np.append(turn, len(start) - 1)]
    anchor, owner = anchor[np.append(0, turn + 1)], owner[np.append(0, turn + 1)]
    shape = ((anchor - first) << 32 | (last - anchor + length)).astype(np.uint64)
    ha = mixed(roll.spans(first, last + length) ^ mixed(shape))
    return {"text": owner, "h": grams[anchor].view(np.int64), "ha": ha.view(np.int64), "first": first - bounds[owner], "last": last - bounds[owner], "lead": anchor - first}


def suffixes(rows: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(row, doc_id, h, ha, first, last, lead): the retained suffixes of rows (row, doc_id, text)."""

    def of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = batch.column("text").to_pylist()
        for low, high in text_parts(texts, _CHARS):
            found = suffixes_of(texts[low:high], length, gram)
            at = pa.array(low + found["text"])
            columns = [batch.column("row").take(at), batch.column("doc_id").take(at), pa.array(found["h"]), pa.array(found["ha"])]
            columns += [pa.array(found[x].astype(np.int32)) for x in ("first", "last", "lead")]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "h", "ha", "first", "last", "lead"])

    return arrow_map(rows.select("row", "doc_id", "text"), of, "row long, doc_id long, h long, ha long, first int, last int, lead int")


def occurrence(*places: str) -> Column:
    """What orders occurrences: rows with an id first, then the id, the row and the places in it."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", *places)


def contexts(places: DataFrame, length: int = LENGTH) -> DataFrame:
    """(h, row, doc_id, at, lo, hi, right, left) for rows (row, doc_id, text, runs): the words from each suffix on, and those before it from
    the nearest to the farthest, each with a space behind it, as far as its windows reach; they start lo to hi words before its place at."""

    def of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        where, found = [], []
        for k, (text, runs) in enumerate(zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist(), strict=True)):
            words = [w + b" " for w in text.encode("utf-8", "surrogatepass").split()]
            for run in runs:
                at = run["first"] + run["lead"]
                where.append(k)
                found.append((run["h"], at, at - run["last"], run["lead"], b"".join(words[at : run["last"] + length]), b"".join(words[run["first"] : at][::-1])))
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        h, at, lo, hi, right, left = (pa.array([x[k] for x in found], kind) for k, kind in enumerate(kinds))
        take = pa.array(where, pa.int32())
        yield pa.RecordBatch.from_arrays([h, batch.column("row").take(take), batch.column("doc_id").take(take), at, lo, hi, right, left], names=["h", "row", "doc_id", "at", "lo", "hi", "right", "left"])

    return arrow_map(places.select("row", "doc_id", "text", "runs"), of, "h long, row long, doc_id long, at int, lo int, hi int, right binary, left binary")


def _shared(texts: list[bytes], runs: np.ndarray) -> np.ndarray:
    """How many words each text shares with the one before it; -1 at the start of a run."""
    out = np.full(len(texts), -1, np.int64)
    before: list[bytes] = []
    for k, text in enumerate(texts):
        words = text.split(b" ")[:-1]
        if k and runs[k] == runs[k - 1]:
            n = 0
            for x, y in zip(before, words, strict=False):
                if x != y:
                    break
                n += 1
            out[k] = n
        before = words
    return out


def extended(runs: np.ndarray, right: list[bytes], left: list[bytes], lo: np.ndarray, hi: np.ndarray, rank: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, a, j): the window that starts a words before suffix i first occurs at suffix j.

    Suffixes are in order by runs (one value for each) and right; rank orders their occurrences.
    """
    n = len(runs)
    back = np.array(sorted(range(n), key=lambda k: (runs[k], left[k])), np.int64)
    ahead, behind = _shared(right, runs), _shared([left[k] for k in back], runs[back])
    first_come = np.argsort(rank, kind="stable")
    out = [np.empty((3, 0), np.int64)]
    for a in range(int(lo.min()), int(hi.max()) + 1):
        here = first_come[((lo <= a) & (a <= hi))[first_come]]
        if len(here) < 2:
            continue
        # Suffixes without a boundary between them share enough words on that side.
        after = np.cumsum(ahead < length - a)
        before = np.empty(n, np.int64)
        before[back] = np.cumsum(behind < a)
        _, at, group = np.unique((after * (n + 1) + before)[here], return_index=True, return_inverse=True)
        first = here[at][group]
        again = first != here
        out.append(np.stack([here[again], np.full(int(again.sum()), a), first[again]]))
    found = np.concatenate(out, axis=1)
    return found[0], found[1], found[2]


def extended_spans(suffixes: DataFrame, length: int = LENGTH) -> DataFrame:
    """(row, first, until, first_doc): the words that repeats cover, from contexts()."""

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for frame in frames:
            own = pa.Table.from_batches([frame])
            own = own if held is None else pa.concat_tables([held, own])
            h = own.column("h").to_numpy()
            turns = np.flatnonzero(h[1:] != h[:-1])
            until = int(turns[-1]) + 1 if len(turns) else 0
            held = own.slice(until)
            if until:
                yield from spans_of(own.slice(0, until))
        if held is not None and len(held):
            yield from spans_of(held)

    def spans_of(part: pa.Table) -> Iterator[pa.RecordBatch]:
        part = part.combine_chunks()
        at, lo, hi, none, row = (part.column(x).to_numpy() for x in ("at", "lo", "hi", "none", "row"))
        rank = np.empty(len(at), np.int64)
        rank[np.lexsort((at, row, part.column("order").to_numpy(), none))] = np.arange(len(at))
        i, a, j = extended(part.column("h").to_numpy(), part.column("right").to_pylist(), part.column("left").to_pylist(), lo, hi, rank, length)
        if not len(i):
            return
        # Windows that follow each other and have first occurrences in the same suffix are one span.
        order = np.lexsort((a, j, i))
        i, a, j = i[order], a[order], j[order]
        new = np.append(0, np.flatnonzero((np.diff(i) != 0) | (np.diff(j) != 0) | (np.diff(a) != 1)) + 1)
        end = np.append(new[1:] - 1, len(i) - 1)
        first, until = at[i[end]] - a[end], at[i[new]] - a[new] + length
        columns = [part.column("row").take(pa.array(i[new])), pa.array(first.astype(np.int32)), pa.array(until.astype(np.int32)), part.column("doc_id").take(pa.array(j[new]))]
        yield from pa.table(columns, names=["row", "first", "until", "first_doc"]).to_batches()

    # A missing id sorts by none; order stands for it among numbers.
    told = suffixes.withColumn("none", F.col("doc_id").isNull().cast("int")).withColumn("order", F.coalesce("doc_id", F.lit(0)))
    return told.repartition("h").sortWithinPartitions("h", "right").mapInArrow(batches, "row long, first int, until int, first_doc long")


def window_hashes(places: DataFrame, length: int = LENGTH) -> DataFrame:
    """(row, doc_id, at, w): digests of the windows that start at first to last, for rows (row, doc_id, text, runs)."""

    def of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts, runs = batch.column("text").to_pylist(), batch.column("runs").to_pylist()
        for low, high in text_parts(texts, _CHARS):
            roll, bounds = word_roller(texts[low:high])
            where, starts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for k in range(low, high):
                for run in runs[k]:
                    starts.append(np.arange(run["first"], run["last"] + 1))
                    where.append(np.full(len(starts[-1]), k))
            at, own = np.concatenate(starts), np.concatenate(where)
            from_word = bounds[own - low] + at
            digests = roll.spans(from_word, from_word + length).view(np.int64)
            take = pa.array(own)
            yield pa.RecordBatch.from_arrays([batch.column("row").take(take), batch.column("doc_id").take(take), pa.array(at.astype(np.int32)), pa.array(digests)], names=["row", "doc_id", "at", "w"])

    return arrow_map(places.select("row", "doc_id", "text", "runs"), of, "row long, doc_id long, at int, w long")


def merged_spans(spans: DataFrame) -> DataFrame:
    """(row, spans, n_removed, first_docs) from (row, first, until, first_doc): overlapping spans united, in order.  A row's spans are
    bounded by its own text."""
    held = spans.groupBy("row").agg(F.collect_list(F.struct("first", "until")).alias("spans"), F.array_sort(F.collect_set("first_doc")).alias("first_docs"))

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            united = []
            for found in frame["spans"]:
                pairs = np.array(sorted((x["first"], x["until"]) for x in found))
                reach = np.maximum.accumulate(pairs[:, 1])
                new = np.append(0, np.flatnonzero(pairs[1:, 0] > reach[:-1]) + 1)
                ends = reach[np.append(new[1:] - 1, len(reach) - 1)]
                united.append([{"first": int(a), "until": int(b)} for a, b in zip(pairs[new, 0], ends, strict=True)])
            yield pd.DataFrame({"row": frame["row"], "spans": united, "n_removed": [sum(x["until"] - x["first"] for x in u) for u in united], "first_docs": frame["first_docs"]})

    return held.mapInPandas(batches, f"row long, spans {SPANS}, n_removed long, first_docs array<long>")


def repeated_words(rows: DataFrame, length: int = LENGTH, gram: int = GRAM, run_rows: int = RUN_ROWS) -> DataFrame:
    """(row, spans, n_removed, first_docs) for each written row (row, doc_id, text) with repeated words; spans count words from 0."""
    if not 0 < gram < length:
        raise ValueError("gram must be under length")
    with scratch(rows.sparkSession) as outlive:
        every = cut(suffixes(rows, length, gram))
        # Counts and minima are written before rows are joined with them: only a join whose sides were both shuffled for it
        # lets Spark split the task of a passage that very many documents share.
        again = cut(every.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
        kept = cut(every.join(again, "h", "left_semi"))
        classes = cut(kept.groupBy("h", "ha").agg(F.min(occurrence("first", "last", "lead")).alias("c")))
        own = classes.select("h", "ha", F.col("c.doc_id").alias("first_doc"), F.col("c.row").alias("first_row"), F.col("c.first").alias("first_at"))
        equal = kept.join(own, ["h", "ha"]).where("row != first_row or first != first_at")
        equal = equal.select("row", "first", (F.col("last") + length).alias("until"), "first_doc")
        several = cut(classes.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"))
        runs = cut(classes.join(several, "h").select("c.row", "n", F.struct("h", "c.first", "c.last", "c.lead").alias("run")))

        def places(chosen: DataFrame) -> DataFrame:
            own = flagged(rows, chosen).where("hit").drop("hit")
            return own.join(chosen.groupBy("row").agg(F.collect_list("run").alias("runs")), "row")

        sorted_part = extended_spans(contexts(places(runs.where(F.col("n") <= run_rows)), length), length)
        windows = cut(window_hashes(places(runs.where(F.col("n") > run_rows)), length))
        lowest = windows.groupBy("w").agg(F.min(occurrence("at")).alias("m"), F.count("*").alias("n")).where("n > 1")
        lowest = cut(lowest.select("w", F.col("m.doc_id").alias("first_doc"), F.col("m.row").alias("first_row"), F.col("m.at").alias("first_at")))
        dealt_part = windows.join(lowest, "w").where("row != first_row or at != first_at")
        dealt_part = dealt_part.select("row", F.col("at").alias("first"), (F.col("at") + length).alias("until"), "first_doc")
        return outlive(merged_spans(equal.unionByName(sorted_part).unionByName(dealt_part)))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, run_rows: int = RUN_ROWS) -> DataFrame:
    """(doc_id, spans, n_removed, first_docs) for each row of docs; spans and first_docs are empty and n_removed 0 where nothing repeats."""
    with scratch(docs.sparkSession) as outlive:
        numbered = rows_of(docs, F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        rows = cut(numbered.select("row", "doc_id", "text"))
        found = rows.select("row", "doc_id").join(repeated_words(rows, length, gram, run_rows), "row", "left")
        return outlive(
            found.select(
                "doc_id",
                F.coalesce("spans", F.array().cast(SPANS)).alias("spans"),
                F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
                F.coalesce("first_docs", F.array().cast("array<long>")).alias("first_docs"),
            )
        )


def without_spans(text: str, spans: list) -> str:
    """text without the words of spans and the white space after them; the rest as it was."""
    words = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for span in spans:
        if span["first"] >= len(words):
            break
        out.append(text[at : words[span["first"]][0]])
        at = words[span["until"]][0] if span["until"] < len(words) else len(text)
    return "".join([*out, text[at:]])


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_removed", "spans", "first_docs")


def cut_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: repeated passages leave the texts; documents of which nothing is left go, all others stay.  The rows, written once,
    are read again by the result, so their table lasts until the caller's scratch() ends."""
    rows, _ = written(rows_of(docs))
    found = repeated_words(rows.select("row", F.col("d.doc_id").cast("long").alias("doc_id"), F.col("d.text").alias("text")))
    each = flagged(rows, found)
    joined = each.where("hit").join(found.select("row", "spans"), "row").select("d", "spans")
    joined = joined.unionByName(each.where("not hit").select("d", F.lit(None).cast(SPANS).alias("spans")))
    names = docs.columns

    def of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        whole, spans = batch.column("d"), batch.column("spans").to_pylist()
        texts = [t if s is None else without_spans(t, s) for t, s in zip(whole.field("text").to_pylist(), spans, strict=True)]
        columns = {name: whole.field(k) for k, name in enumerate(names)}
        columns["text"] = pa.array(texts, whole.field("text").type)
        if "n_chars" in columns:
            told = [n if s is None else len(t) for n, t, s in zip(columns["n_chars"].to_pylist(), texts, spans, strict=True)]
            columns["n_chars"] = pa.array(told, columns["n_chars"].type)
        stay = pa.array([s is None or bool(t.strip()) for t, s in zip(texts, spans, strict=True)], pa.bool_())
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=names).filter(stay)

    return arrow_map(joined, of, T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema]))
