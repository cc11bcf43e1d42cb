"""Language identification of mixed-language text.

Training counts byte trigrams of lower-cased words by language.  A word's score
for a language is the sum of its trigrams' log-probabilities; the script of its
letters narrows the candidates to languages seen in that script.  A Viterbi
path over the words, with a penalty for each switch of language, labels spans,
and the language that holds most word bytes is the document's.

Scoring is one narrow Arrow pass.  All texts of a batch are scored as one byte
array; a text whose constant path is provably best (no span gains half the
switching penalty on it) needs no dynamic programme, and the others share one
that steps over all of them together.

Training reads at most ``max_docs`` whole texts of each language, those with
the smallest hash of doc_id and text (equal rows count once): a documented bound
on the fit alone.  More than MAX_LANGS
languages raise, so what is broadcast and fetched is bounded.

Defined cases: null, empty and letterless texts are ``und`` with score 0; a
table without labelled rows labels every text ``und``, and an empty table gives
an empty result; a text whose letters match no learned script is scored on all
languages; ties go to the language first in alphabetical order; repeated rows
and rows of one id are labelled each by its own text; a null id is never held
out; a very long text is a batch of its own, scored whole (8 bytes a word and
language); other columns are ignored by identify() and kept by keep_identified().
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import arrow_map, cut, rows_of, table, text_batches, text_parts, whole

UNKNOWN = "und"
MAX_DOCS = 1500
#: Distinct values of lang that a model may have; more raise, since the model (256 KB a language) goes to every task.
MAX_LANGS = 400
SWITCH = 12.0
#: Trigrams are hashed to so many slots.
SLOTS = 1 << 16
_LETTER = regex.compile(r"\p{L}")
_CHARS = 2_000_000
#: Score of a word for a language that doesn't write its script.
_NO_SCRIPT = -30.0

# First and last code points of the scripts told apart, from the public Unicode blocks.
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
}
NAMES = list(SCRIPTS)


def _lead_table() -> np.ndarray:
    """For the first two bytes of a character in UTF-8 (high byte first): one bit for its script, 0 for none."""
    found = np.zeros(1 << 16, np.uint32)
    for k, name in enumerate(NAMES):
        for low, high in SCRIPTS[name]:
            for point in {*range(low, high + 1, 1 if high - low < 4096 else 64), high}:
                data = chr(point).encode("utf-8", "surrogatepass")
                if len(data) == 1:
                    found[data[0] << 8 : (data[0] + 1) << 8] |= np.uint32(1 << k)
                else:
                    found[data[0] << 8 | data[1]] |= np.uint32(1 << k)
    return found


LEADS = _lead_table()


@dataclass(frozen=True)
class Model:
    """langs in alphabetical order; weights[slot, lang]: log-probabilities; scripts[lang]: bits of scripts it is written in."""

    langs: tuple[str, ...]
    weights: np.ndarray
    scripts: np.ndarray


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' words as one byte array with a space before, between and after them; word starts; each text's first word."""
    lines = [" ".join(t.lower().split()).encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" " + b" ".join(x for x in lines if x) + b"  \0", np.uint8)
    spaces = np.flatnonzero(data[:-2] == 32)
    sizes = np.array([x.count(b" ") + 1 if x else 0 for x in lines], np.int64)
    return data, spaces[:-1], np.append(0, np.cumsum(sizes))


def _slots(data: np.ndarray) -> np.ndarray:
    wide = data.astype(np.uint32)
    code = (wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:]
    return (code * np.uint32(2654435761)) >> np.uint32(16)


def fit(labelled: DataFrame, max_docs: int = MAX_DOCS, smoothing: float = 0.5) -> Model:
    """A model from columns doc_id, text and lang (rows where lang or text is null are left out)."""
    # A row's key says which rows are read, whether or not its id is null or occurs again.
    known = labelled.where("lang is not null and text is not null").select("lang", "text", F.xxhash64("doc_id", "text").alias("key"))
    sizes = cut(known.groupBy("lang").agg(F.approx_count_distinct("key").alias("n")))
    if sizes.count() > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} values of lang")
    # A threshold that lets about twice max_docs rows of each language pass bounds what the ranking has to gather.
    place = F.pmod("key", F.lit(1 << 30))
    near = place < F.lit(2.0 * max_docs * (1 << 30)) / F.col("n")
    # Broadcast: at most MAX_LANGS rows, then at most max_docs rows for each of them.
    few = known.select("lang", "key").join(F.broadcast(sizes), "lang").where(near).select("lang", "key").distinct()
    own = Window.partitionBy("lang").orderBy(place, "key")
    chosen = cut(few.withColumn("at", F.row_number().over(own)).where(F.col("at") <= max_docs).select("lang", "key"))
    sample = known.join(F.broadcast(chosen), ["lang", "key"], "left_semi").dropDuplicates(["lang", "key"]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            groups: dict[str, list[str]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                groups.setdefault(lang, []).append(text)
            for lang, texts in groups.items():
                data, starts, _ = _words(texts)
                if lang not in sums:
                    sums[lang] = np.zeros(SLOTS + len(NAMES), np.int64)
                if len(starts):
                    sums[lang][:SLOTS] += np.bincount(_slots(data)[: len(data) - 3], minlength=SLOTS)
                    bits = LEADS[(data[:-1].astype(np.uint32) << 8) | data[1:]]
                    sums[lang][SLOTS:] += [int(((bits >> k) & 1).sum()) for k in range(len(NAMES))]
        for lang, total in sums.items():
            on = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(on), pa.string()), pa.array(on), pa.array(total[on])], names=["lang", "slot", "n"])

    counts = text_batches(sample).mapInArrow(count, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    langs = tuple(sorted(counts["lang"].unique()))  # at most MAX_LANGS times SLOTS rows were fetched
    sums = np.zeros((SLOTS + len(NAMES), len(langs)))
    sums[counts["slot"].to_numpy(), [langs.index(x) for x in counts["lang"]]] = counts["n"].to_numpy()
    grams = sums[:SLOTS] + smoothing
    letters = sums[SLOTS:]
    share = letters / np.maximum(letters.sum(axis=0), 1)
    scripts = ((share >= 0.01) << np.arange(len(NAMES))[:, None]).sum(axis=0)
    return Model(langs, np.log(grams / np.maximum(grams.sum(axis=0), 1)).astype(np.float32), scripts.astype(np.uint32))


def word_scores(model: Model, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word: its score by language relative to the languages' mean, and its bytes."""
    slots = _slots(data)
    until = np.append(starts[1:], len(data) - 3)
    scores = np.empty((len(starts), len(model.langs)), np.float64)
    for k in range(len(model.langs)):
        scores[:, k] = np.add.reduceat(model.weights[:, k][slots[: until[-1]]], starts)
    scores -= scores.mean(axis=1, keepdims=True)
    bits = np.bitwise_or.reduceat(LEADS[(data[:-1].astype(np.uint32) << 8) | data[1:]][: until[-1]], starts)
    outside = (bits[:, None] & model.scripts[None, :]) == 0
    narrowed = outside & ~outside.all(axis=1, keepdims=True)
    scores[narrowed] = _NO_SCRIPT
    scores[bits == 0] = 0.0
    return np.clip(scores, _NO_SCRIPT, None), np.where(bits == 0, 0, until - starts - 1)


def viterbi(scores: list[np.ndarray], switch: float = SWITCH) -> list[np.ndarray]:
    """The best path of each text (scores: words by languages), all texts stepped together."""
    order = sorted(range(len(scores)), key=lambda k: -len(scores[k]))
    sizes = np.array([len(scores[k]) for k in order])
    kind = np.min_scalar_type(scores[0].shape[1])
    back = [np.zeros((n, scores[0].shape[1]), kind) for n in sizes]
    best = np.stack([scores[k][0] for k in order])
    offsets = np.append(0, np.cumsum(sizes))[:-1]
    flat = np.concatenate([scores[k] for k in order])
    trace = np.concatenate(back)
    own = np.arange(best.shape[1], dtype=kind)
    for step in range(1, int(sizes[0])):
        on = int(np.searchsorted(-sizes, -step, side="left"))
        top = best[:on].argmax(axis=1)
        jump = best[np.arange(on), top] - switch
        stay = best[:on] >= jump[:, None]
        trace[offsets[:on] + step] = np.where(stay, own, top[:, None].astype(kind))
        best[:on] = np.where(stay, best[:on], jump[:, None]) + flat[offsets[:on] + step]
    state = best.argmax(axis=1)
    paths: list[np.ndarray] = [np.empty(0, kind)] * len(scores)
    for row, k in enumerate(order):
        path, now = np.empty(sizes[row], kind), int(state[row])
        own_trace = trace[offsets[row] : offsets[row] + sizes[row]]
        for step in range(int(sizes[row]) - 1, -1, -1):
            path[step] = now
            now = int(own_trace[step, now])
        paths[k] = path
    return paths


def label_batch(model: Model, texts: list[str | None], switch: float = SWITCH) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
    """For each text: language, score, and spans (first word, end, language) of white-space words."""
    out: list[tuple[str, float, list[tuple[int, int, str]]]] = [(UNKNOWN, 0.0, [])] * len(texts)
    use = [k for k, t in enumerate(texts) if t and model.langs and _LETTER.search(t)]
    if not use:
        return out
    data, starts, first = _words([texts[k] for k in use])
    scores, sizes = word_scores(model, data, starts)
    running = np.vstack([np.zeros((1, scores.shape[1])), np.cumsum(scores, axis=0)])
    totals = running[first[1:]] - running[first[:-1]]
    top = totals.argmax(axis=1)
    scaled = totals / np.sqrt(np.maximum(np.diff(first), 1))[:, None]
    posterior = 1 / np.exp(scaled - scaled.max(axis=1, keepdims=True)).sum(axis=1)
    held: list[int] = []
    paths: dict[int, np.ndarray] = {}
    for row in range(len(use)):
        a, b = first[row], first[row + 1]
        over = running[a : b + 1] - running[a : b + 1, top[row], None]
        gain = (over - np.minimum.accumulate(over, axis=0)).max(axis=0)
        if (np.delete(gain, top[row]) > switch / 2).any():
            held.append(row)
    if held:
        paths = dict(zip(held, viterbi([scores[first[r] : first[r + 1]] for r in held], switch), strict=True))
    bytes_before = np.append(0, np.cumsum(sizes))
    for row, k in enumerate(use):
        a, b = first[row], first[row + 1]
        if row in paths:
            path = paths[row]
            share = np.bincount(path, weights=sizes[a:b], minlength=len(model.langs))
            lang = int(share.argmax())
            turns = np.append(0, np.flatnonzero(path[1:] != path[:-1]) + 1)
            spans = [(int(s), int(e), model.langs[path[s]]) for s, e in zip(turns, [*turns[1:], b - a], strict=True)]
            part = float(share[lang] / max(share.sum(), 1))
        else:
            lang, spans = int(top[row]), [(0, int(b - a), model.langs[top[row]])]
            # Confidence of a single span: its posterior, tempered by the text's length so that it doesn't saturate.
            part = float(posterior[row])
        out[k] = (model.langs[lang], part if bytes_before[b] > bytes_before[a] else 0.0, spans)
    return out


def label_texts(model: Model, texts: list[str | None], switch: float = SWITCH) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
    """label_batch for any number of texts, some _CHARS characters at a time."""
    return [x for low, high in text_parts(texts, _CHARS) for x in label_batch(model, texts[low:high], switch)]


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", switch: float = SWITCH) -> DataFrame:
    """(doc_id, lang_pred, score, spans) for each row of docs."""
    span = pa.struct([("first", pa.int32()), ("until", pa.int32()), ("lang", pa.string())])

    def of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = label_texts(model, batch.column("text").to_pylist(), switch)
        spans = pa.array([[dict(zip(("first", "until", "lang"), y, strict=True)) for y in x[2]] for x in found], pa.list_(span))
        columns = [batch.column("doc_id"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), spans]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score", "spans"])

    schema = "doc_id long, lang_pred string, score double, spans array<struct<first:int,until:int,lang:string>>"
    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), of, schema)


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without an identifiable language go; all others pass whole and unchanged."""
    model = fit(docs)

    def of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        langs = label_texts(model, batch.column("d").field("text").to_pylist())
        yield batch.filter(pa.array([x[0] != UNKNOWN for x in langs], pa.bool_()))

    schema = T.StructType([T.StructField("d", docs.schema)])
    return whole(arrow_map(rows_of(docs).select("d"), of, schema), docs)
