"""A learned ranker of the tokens that a user is likely to misspell: features, training groups, boosted trees, selection.

A training group is one past error: the tokens of its span after correction, of
which the corrected one is relevant.  Groups are rows with arrays, so a group is
never split and its pairs never leave a task; a group is as long as its span.

Training is gradient boosting with pairwise lambda gradients.  For each level of
a tree one pass over the groups ranks their tokens by the scores so far, derives
each token's gradient and second derivative from all pairs of unlike relevance,
and adds them up by (node, feature, bin).  Only those histograms, whose size is
nodes x features x bins whatever the number of rows, meet on the driver, which
picks the splits.  Sums are of fixed-point numbers, so they don't depend on how
rows are dealt.  Features are read as bins, written once; a tree's last histogram
gives its leaves too.  Every FOLD trees the scores are written beside the rows.

Defined cases: groups without a pair of unlike relevance have no gradient; ties
in score rank by position; null features count as 0; without any row training
raises ValueError; a query without tokens has no selection, one without
a resembling past error keeps its text.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from quillon.functions import errors as er
from quillon.functions import text as tx
from quillon.operators.storage import bounded_batches, writer

FEATURES = (
    "topk_sim", "char_score", "bigram_score", "surface_difficulty", "attr_risk", "phonetic_ratio", "visual_ratio", "spelling_ratio",
    "is_color", "is_size", "is_brand", "is_flavor", "is_material", "is_species", "user_error_rate", "token_len", "has_upper", "has_digit",
    "has_rare_char", "has_double_letter", "vowel_ratio",
)
#: Bins of a feature, and the unit of the fixed-point sums of gradients.
BINS, UNIT = 32, float(1 << 24)
FOLD = 8
#: Pairs of tokens that a task holds at once.
PAIRS = 1 << 20
#: Groups of a block whose distinct tokens are judged once, and tasks over which a user's groups are dealt.
GROUPS, SHARES = 4096, 4
#: Groups that a task passes on at once with their features.
PIECE = 256
#: Values of a feature that a task's summary holds while it reads, and passes on.
HELD, PASSED = 1 << 16, 1 << 12


def content_tokens(text: Column, stop_words: Sequence[str] = ()) -> Column:
    """The query tokens of text but for numbers, single characters and stop words."""
    kept = F.filter(tx.query_tokens(text), lambda w: (F.length(w) >= 2) & ~w.rlike("^[0-9]+$"))
    return F.filter(kept, lambda w: ~F.lower(w).isin(*stop_words)) if stop_words else kept


def user_profiles(errors: DataFrame) -> DataFrame:
    """(user_id, error_words, char_freq, bigram_freq, n_errors, phonetic_ratio, visual_ratio, spelling_ratio) from (user_id, original, corrected)."""
    from quillon.operators import profiles

    kind = er.error_type(F.col("original"), F.col("corrected"))
    ratios = errors.groupBy("user_id").agg(*(F.avg((kind == k).cast("double")).alias(f"{k}_ratio") for k in ("phonetic", "visual", "spelling")))
    return profiles.error_profile(errors).select("user_id", "error_words", "char_freq", "bigram_freq", "n_errors").join(ratios, "user_id")


def similarities(user: pa.Array, tokens: pa.Array, words: pa.Array) -> pa.Array:
    """For each lower-cased token the greatest Jaccard similarity of its set of characters to those of the user's lower-cased words; 0 without words.

    A user's words are the same in all of their rows.  Distinct tokens and distinct sets alone are compared, as products of 0/1 matrices.
    """
    ends, flat = np.append(0, np.cumsum(np.array([len(t or ()) for t in tokens.to_pylist()], np.int64))), tokens.flatten().dictionary_encode()
    codes, names = flat.indices.to_numpy(), flat.dictionary.to_pylist()
    users, out = user.dictionary_encode(null_encoding="encode").indices.to_numpy(), np.zeros(len(codes))
    for one in np.unique(users).tolist():
        rows = np.flatnonzero(users == one)
        # By size, so that of the sets of one size the greatest common part decides.
        sets = sorted({frozenset(w) for w in words[int(rows[0])].as_py() or () if w is not None}, key=len)
        if not sets:
            continue
        at = np.concatenate([np.arange(ends[r], ends[r + 1]) for r in rows])
        wanted, back = np.unique(codes[at], return_inverse=True)
        letters = {c: k for k, c in enumerate(sorted(frozenset().union(*sets)))}
        held = np.zeros((len(sets), len(letters)), np.float32)
        for k, chars in enumerate(sets):
            held[k, [letters[c] for c in chars]] = 1
        sizes, firsts = np.unique([len(s) for s in sets], return_index=True)
        # Words of the same characters are compared once.
        asked = [frozenset(names[k]) for k in wanted.tolist()]
        alike = {chars: k for k, chars in enumerate(dict.fromkeys(asked))}
        distinct, best = list(alike), np.zeros(len(alike))
        step = max(PAIRS // len(sets), 1)
        for low in range(0, len(distinct), step):
            part = distinct[low : low + step]
            own = np.zeros((len(part), len(letters)), np.float32)
            for k, chars in enumerate(part):
                own[k, [letters[c] for c in chars if c in letters]] = 1
            common = np.maximum.reduceat(held @ own.T, firsts, axis=0).astype(np.float64)
            union = np.array([len(s) for s in part], np.float64) + sizes[:, None] - common
            best[low : low + step] = np.divide(common, union, out=np.zeros_like(common), where=union > 0).max(axis=0)
        best = best[[alike[chars] for chars in asked]]
        out[at] = best[back]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out))


def profile_scores(tokens: pa.Array, letters: pa.Array, chars: pa.Array, bigrams: pa.Array) -> pa.Array:
    """For each lower-cased token the error_char_score and error_bigram_score of errors.py; letters: of each token, how many of its characters are.

    A profile's counts are looked up in a table of their own, not along a map.
    """
    out: list[tuple[float, float]] = []
    for own, many, one, two in zip(tokens, letters, chars, bigrams, strict=True):
        single, double = ({e["key"]: e["value"] for e in counts.as_py() or ()} for counts in (one, two))
        most, top = float(max(single.values(), default=1)), float(max(double.values(), default=1))
        for token, n in zip(own.as_py() or (), many.as_py() or (), strict=True):
            if token is None:
                out.append((0.0, 0.0))
                continue
            known = [c for c in token if c in single]
            boost = 0.0
            for c in known:
                boost += (single[c] / most) * (token.count(c) / n if n else 0.0)
            total = 0.0
            for at in range(len(token) - 1):
                total += double.get(token[at : at + 2], 0) / top
            out.append((min(len(known) / n + boost * 0.5, 1.0) if n and single else 0.0, min(total / (len(token) - 1), 1.0) if len(token) > 1 and double else 0.0))
    ends = np.append(0, np.cumsum([len(t) if t.is_valid else 0 for t in tokens]))
    values = np.array(out, np.float64).reshape(-1, 2)
    pair = pa.StructArray.from_arrays([pa.array(values[:, 0]), pa.array(values[:, 1])], names=["char_score", "bigram_score"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pair)


def token_features(token: Column, keywords: Mapping[str, Sequence[str]] | None = None, similarity: Column | None = None, scores: Column | None = None) -> Column:
    """The FEATURES of a token as an array, beside columns of user_profiles().  keywords: word lists by colors, sizes, flavors, materials, species.

    similarity (topk_sim) and profile_scores() are computed here unless they are given.
    """
    low, flag = F.lower(token), lambda c: F.when(c, 1.0).otherwise(0.0)
    words = lambda name: flag(low.isin(*keywords[name])) if keywords and keywords.get(name) else F.lit(0.0)
    vowels = F.length(F.regexp_replace(low, "[^aeiou]", "")).cast("double")
    values = {
        "topk_sim": F.array_max(F.transform("error_words", lambda e: er.char_similarity(token, e))) if similarity is None else similarity,
        "char_score": er.error_char_score(token, F.col("char_freq")) if scores is None else scores["char_score"],
        "bigram_score": er.error_bigram_score(token, F.col("bigram_freq")) if scores is None else scores["bigram_score"],
        "surface_difficulty": er.surface_difficulty(token),
        "attr_risk": er.attribute_risk(token, F.array().cast("array<string>")),
        **{f"{k}_ratio": F.col(f"{k}_ratio") for k in ("phonetic", "visual", "spelling")},
        **{f"is_{one}": words(many) for one, many in (("color", "colors"), ("size", "sizes"), ("flavor", "flavors"), ("material", "materials"), ("species", "species"))},
        "is_brand": flag(token.rlike("^\\p{Lu}") & token.rlike("\\p{Ll}") & (F.length(token) > 2)),
        "user_error_rate": F.least(F.col("n_errors") / 10.0, F.lit(1.0)),
        "token_len": F.length(token).cast("double"),
        "has_upper": flag(token.rlike("\\p{Lu}")),
        "has_digit": flag(token.rlike("[0-9]")),
        "has_rare_char": flag(low.rlike("[wxqz]")),
        "has_double_letter": flag(token.rlike("(.)\\1")),
        "vowel_ratio": vowels / F.greatest(F.length(token), F.lit(1)),
    }
    return F.array(*(F.coalesce(values[name], F.lit(0.0)).cast("double") for name in FEATURES))


def _spread(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The groups of blocks (rows, words, x) with the features of each token, found by its place among the block's words."""
    for batch in batches:
        for k in range(batch.num_rows):
            every, words = batch.column(0)[k].values, batch.column(1)[k].values
            known = batch.column(2)[k].values.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            for at in range(0, len(every), PIECE):
                rows = every.slice(at, PIECE)
                tokens = pc.struct_field(rows, "tokens")
                x = known[pc.index_in(tokens.flatten(), value_set=words).to_numpy(zero_copy_only=False)]
                each = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                ends = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)))
                held = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each, mask=pc.is_null(tokens))
                yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip([*rows.flatten(), held], schema, strict=True)], schema=schema)


def featured(groups: DataFrame, profiles: DataFrame, keywords: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """groups (user_id, tokens, ...) of users with a profile, with x, the features of each token.

    Features are of a user and a token, so a user's groups are gathered in blocks of at most GROUPS and each distinct token of a block
    is judged once.  A profile meets a block, not each of its groups: a user's words and groups both grow with the input.
    """
    bounded_batches(groups.sparkSession)
    types = StructType([*groups.schema, StructField("x", ArrayType(ArrayType(DoubleType())))])
    schema = to_arrow_schema(types)
    # A user's groups are dealt over SHARES tasks; numbers within a task cut them into blocks.
    share = F.pmod(F.xxhash64("tokens"), F.lit(SHARES))
    sorted_ = groups.select("user_id", share.alias("share"), F.struct(*groups.columns).alias("row")).repartition("user_id", "share").sortWithinPartitions("user_id", "share", F.xxhash64("row.tokens"))
    numbered = sorted_.withColumn("block", F.floor(F.monotonically_increasing_id() / GROUPS))
    blocks = numbered.groupBy("user_id", "share", "block").agg(F.collect_list("row").alias("rows"))
    # Words are dear and their rows have few bytes, so blocks are dealt evenly.
    words = F.array_distinct(F.flatten(F.filter("rows.tokens", lambda t: t.isNotNull()))).alias("words")
    joined = blocks.select("user_id", "rows", words).repartition(4 * groups.sparkSession.sparkContext.defaultParallelism).join(profiles, "user_id")
    low = F.transform("words", F.lower)
    letters = F.transform("words", lambda w: F.length(F.regexp_replace(F.lower(w), "\\P{L}", "")))
    alike = F.arrow_udf(similarities, ArrayType(DoubleType()))("user_id", low, F.transform("error_words", F.lower))
    scores = F.arrow_udf(profile_scores, "array<struct<char_score: double, bigram_score: double>>")(low, letters, F.map_entries("char_freq"), F.map_entries("bigram_freq"))
    known = joined.withColumn("given", F.arrays_zip(alike.alias("similarity"), scores.alias("scores")))
    judged = known.select("rows", "words", F.zip_with("words", "given", lambda w, g: token_features(w, keywords, g["similarity"], g["scores"])).alias("x"))
    return judged.mapInArrow(lambda batches: _spread(batches, schema), types)


def training_groups(errors: DataFrame, stop_words: Sequence[str] = ()) -> DataFrame:
    """(group_id, user_id, tokens, y) from errors (group_id, user_id, original, corrected, span_text).

    The first occurrence of the wrong form in the span, in any case, is corrected; y is 1 for the first token that equals the corrected
    form, in any case.  Spans in which none does give no group.
    """
    o, c, span = F.col("original"), F.col("corrected"), F.col("span_text")
    at = F.instr(F.lower(span), F.lower(o))
    clean = F.when(at > 0, F.overlay(span, c, at, F.length(o))).otherwise(span)
    filled = errors.where((o != "") & (c != "") & (span != ""))
    tokens = filled.select("group_id", "user_id", F.lower(c).alias("c"), content_tokens(clean, stop_words).alias("tokens"))
    place = F.array_position(F.transform("tokens", F.lower), F.col("c"))
    # No lambda over tokens, in which the place would be looked for again for each of them.
    zeros = lambda n: F.array_repeat(F.lit(0), n.cast("int"))
    y = F.concat(zeros(place - 1), F.array(F.lit(1)), zeros(F.size("tokens") - place))
    return tokens.where(place > 0).select("group_id", "user_id", "tokens", y.alias("y"))


@dataclass(frozen=True)
class Tree:
    """A complete binary tree: inner nodes in level order with feature and bound (value <= bound goes left), and the leaves' values."""

    feature: tuple[int, ...]
    bound: tuple[float, ...]
    leaf: tuple[float, ...]


@dataclass(frozen=True)
class Ranker:
    """Boosted trees; score() is their sum as a column expression."""

    trees: tuple[Tree, ...] = field(default_factory=tuple)

    def score(self, x: Column) -> Column:
        def below(tree: Tree, node: int) -> Column:
            inner = len(tree.feature)
            if node >= inner:
                return F.lit(tree.leaf[node - inner])
            if tree.bound[node] == float("inf"):
                return below(tree, 2 * node + 1)
            return F.when(F.get(x, F.lit(tree.feature[node])) <= tree.bound[node], below(tree, 2 * node + 1)).otherwise(below(tree, 2 * node + 2))

        return sum((below(tree, 0) for tree in self.trees), F.lit(0.0))

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for tree in self.trees:
            total += np.array(tree.leaf)[leaves(tree, x)]
        return total


def leaves(tree: Tree, x: np.ndarray) -> np.ndarray:
    """Which leaf each row of x falls into."""
    node, inner = np.zeros(len(x), np.int64), len(tree.feature)
    feature, bound = np.array(tree.feature, np.int64), np.array(tree.bound)
    for _ in range((inner + 1).bit_length() - 1):
        node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > bound[node])
    return node - inner


def lambdas(scores: np.ndarray, y: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of groups with a token or more: gradients and second derivatives of all tokens of groups of the given sizes: for each pair of unlike relevance the logistic loss of
    its order, weighted by what swapping both ranks changes in the group's NDCG."""
    group = np.repeat(np.arange(len(sizes)), sizes)
    starts = np.cumsum(sizes) - sizes
    order = np.lexsort((np.arange(len(y)), -scores, group))
    rank = np.empty(len(y), np.int64)
    rank[order] = np.arange(len(y)) - np.repeat(starts, sizes)
    discount = 1 / np.log2(rank + 2.0)
    gain = 2.0**y - 1
    best = np.lexsort((-y, group))
    ideal = np.bincount(group, weights=gain[best] / np.log2(np.arange(len(y)) - np.repeat(starts, sizes) + 2.0), minlength=len(sizes))
    # Only tokens above the least relevance of their group come first in a pair.
    lead = np.flatnonzero(y > np.minimum.reduceat(y, starts)[group])
    width = sizes[group[lead]]
    i = np.repeat(lead, width)
    j = np.repeat(starts[group[lead]] - (np.cumsum(width) - width), width) + np.arange(len(i))
    unlike = y[i] > y[j]
    i, j = i[unlike], j[unlike]
    change = (gain[i] - gain[j]) * np.abs(discount[i] - discount[j]) / ideal[group[i]]
    rho = 1 / (1 + np.exp(np.clip(scores[i] - scores[j], -50, 50)))
    g = np.bincount(i, rho * change, len(y)) - np.bincount(j, rho * change, len(y))
    h = np.bincount(i, rho * (1 - rho) * change, len(y)) + np.bincount(j, rho * (1 - rho) * change, len(y))
    return g, h


def _pieces(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of groups of about PAIRS pairs each."""
    low = total = 0
    for k, n in enumerate(sizes.tolist()):
        total += n * n
        if total >= PAIRS:
            yield low, k + 1
            low, total = k + 1, 0
    if low < len(sizes):
        yield low, len(sizes)


def _flat(column: pa.Array, kind: type) -> np.ndarray:
    """The bytes of a batch's binary values, end to end, as numbers."""
    column = column.cast(pa.binary())
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", kind, (ends[-1] - ends[0]) // np.dtype(kind).itemsize, int(ends[0]))


def _packed(values: np.ndarray, sizes: np.ndarray, width: int = 1) -> pa.Array:
    """Binary values, one for each of the sizes, of width numbers a token."""
    ends = np.append(0, np.cumsum(sizes)) * (width * values.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _arrays(batch: pa.RecordBatch, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(x, y, scores so far, sizes) of pieces of a batch of groups, as arrays or as coded() gives them."""
    if "n" in batch.schema.names:
        sizes = batch.column("n").to_numpy()
        flat_x, flat_y, flat_s = _flat(batch.column("x"), np.uint16).reshape(-1, width), _flat(batch.column("y"), np.float64), _flat(batch.column("s"), np.float64)
    else:
        y = batch.column("y")
        sizes = np.diff(y.offsets.to_numpy())
        flat_y = y.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        flat_x = np.nan_to_num(batch.column("x").flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, width))
        flat_s = batch.column("s").flatten().to_numpy(zero_copy_only=False)
    ends = np.append(0, np.cumsum(sizes))
    for low, high in _pieces(sizes):
        at = slice(ends[low], ends[high])
        yield flat_x[at], flat_y[at], flat_s[at], sizes[low:high]


def coded(rows: DataFrame, edges: np.ndarray) -> DataFrame:
    """Groups (x, y, s) as rows (n, x, y, s) of bytes: the bin of each token's features instead of their values."""
    width = edges.shape[0]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y, s, sizes in _arrays(batch, width):
                bins = np.stack([np.searchsorted(edges[f], x[:, f], "left") for f in range(width)], axis=1).astype(np.uint16)
                yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int64()), _packed(bins, sizes, width), _packed(y, sizes), _packed(s, sizes)], names=["n", "x", "y", "s"])

    return rows.select("x", "y", "s").mapInArrow(code, "n long, x binary, y binary, s binary")


def scored_so_far(rows: DataFrame, trees: Sequence[Tree], width: int) -> DataFrame:
    """coded() rows whose scores have those of trees, with bounds by bin, added."""
    model = Ranker(tuple(trees))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, s = _flat(batch.column("x"), np.uint16).reshape(-1, width), _flat(batch.column("s"), np.float64)
            yield batch.set_column(3, "s", _packed(s + model.predict(x), batch.column("n").to_numpy()))

    return rows.mapInArrow(add, rows.schema)


def histogram(rows: DataFrame, trees: list[Tree], tree: Tree, edges: np.ndarray) -> np.ndarray:
    """Sums of (gradient, second derivative, rows) by (leaf of the tree so far, feature, bin), over groups (x, y, s) with a token or more.

    Of coded() rows the trees' bounds are bins; edges give no more than their number then.
    """
    width, bins = edges.shape[0], edges.shape[1] + 1
    slots = len(tree.leaf) * width * bins

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, len(tree.leaf) * bins, 3))
        model = Ranker(tuple(trees))
        for batch in batches:
            for x, y, s, sizes in _arrays(batch, width):
                g, h = lambdas(s + model.predict(x), y, sizes)
                node = leaves(tree, x) * bins
                sums = (np.rint(g * UNIT), np.rint(h * UNIT), None)
                whole = [np.bincount(node, values, total.shape[1]) for values in sums]
                for f in range(width):
                    at = x[:, f] if x.dtype == np.uint16 else np.searchsorted(edges[f], x[:, f], "left")
                    # Features that are the same everywhere, as word lists that aren't given.
                    same = not at.any()
                    slot = node if same else node + at
                    for k, values in enumerate(sums):
                        total[f, :, k] += whole[k] if same else np.bincount(slot, values, total.shape[1])
        # Whole numbers below 2**53, which doubles add exactly; nodes come first.
        whole = np.rint(total).astype(np.int64).reshape(width, len(tree.leaf), bins, 3).swapaxes(0, 1).reshape(-1, 3)
        at = np.flatnonzero(whole.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(whole[at, k]) for k in range(3))], names=["slot", "g", "h", "n"])

    found = rows.select(*(c for c in ("n", "x", "y", "s") if c in rows.columns)).mapInArrow(add, "slot long, g long, h long, n long").groupBy("slot").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))
    out = np.zeros((slots, 3))
    for row in found.collect():
        out[row.slot] = row.g / UNIT, row.h / UNIT, row.n
    return out.reshape(len(tree.leaf), width, bins, 3)


def best_split(sums: np.ndarray, smooth: float, least: int) -> tuple[int, int] | None:
    """(feature, bin) whose rows up to that bin go left, with the greatest gain; None if no split gains."""
    left = np.cumsum(sums, axis=1)[:, :-1]
    whole = sums.sum(axis=1, keepdims=True)
    right = whole - left
    gain = left[..., 0] ** 2 / (left[..., 1] + smooth) + right[..., 0] ** 2 / (right[..., 1] + smooth) - whole[..., 0] ** 2 / (whole[..., 1] + smooth)
    gain = np.where((left[..., 2] >= least) & (right[..., 2] >= least), gain, 0.0)
    at = np.unravel_index(int(gain.argmax()), gain.shape)
    return (int(at[0]), int(at[1])) if gain[at] > 1e-9 else None


def _summary(values: np.ndarray, counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted values with their counts, added up where equal; beyond most of them, runs of at most 1/most of all counts pass as their last value."""
    values, back = np.unique(values, return_inverse=True)
    counts = np.bincount(back, counts, len(values)).astype(np.int64)
    if len(values) <= most:
        return values, counts
    total = np.cumsum(counts)
    last = np.append(np.flatnonzero(np.diff((total - 1) * most // int(total[-1]))), len(values) - 1)
    return values[last], np.diff(total[last], prepend=0)


def bin_edges(rows: DataFrame, bins: int = BINS) -> np.ndarray:
    """Upper bounds of the bins of each feature: quantiles of all tokens, padded with infinity where values repeat.

    A task passes on a summary of each feature: all distinct values with their counts, up to PASSED of them, else as many quantiles.
    """

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            each = batch.column(0).flatten()
            if not len(each):
                continue
            x = np.nan_to_num(each.flatten().to_numpy(zero_copy_only=False).reshape(len(each), -1))
            held = held or [(np.zeros(0), np.zeros(0, np.int64))] * x.shape[1]
            for f, (values, counts) in enumerate(held):
                new, many = np.unique(x[:, f], return_counts=True)
                held[f] = _summary(np.append(values, new), np.append(counts, many), HELD)
        for f, one in enumerate(held):
            values, counts = _summary(*one, PASSED)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), f)), pa.array(values), pa.array(counts)], names=["f", "value", "n"])

    def cut(key: tuple, table: pa.Table) -> pa.Table:
        values, counts = _summary(table["value"].to_numpy(), table["n"].to_numpy(), len(table))
        total = np.cumsum(counts)
        found = values[np.searchsorted(total, np.ceil(np.arange(1, bins) * int(total[-1]) / bins))]
        return pa.table({"f": [key[0].as_py()], "edges": [np.unique(found).tolist()]})

    cuts = rows.select("x").mapInArrow(tell, "f long, value double, n long").groupBy("f").applyInArrow(cut, "f long, edges array<double>").collect()
    out = np.full((max((r["f"] + 1 for r in cuts), default=len(FEATURES)), bins - 1), np.inf)
    for r in cuts:
        out[r["f"], : len(r["edges"])] = r["edges"]
    return out


def train(groups: DataFrame, rounds: int = 24, depth: int = 3, rate: float = 0.1, smooth: float = 1.0, least: int = 5, bins: int = BINS) -> Ranker:
    """Boosted trees over groups (group_id, x array<array<double>>, y array<int>); scores so far are written to the shared folder."""
    bounded_batches(groups.sparkSession)
    keep = writer(groups.sparkSession, "ranker")
    rows = groups.where(F.size("y") > 0).select("x", "y", F.transform("y", lambda _: F.lit(0.0)).alias("s"))
    edges = bin_edges(rows, bins)
    # Read once a level from here on, as bins; trees have bins for bounds until they are grown.
    rows = keep(coded(rows, edges))
    if rows.isEmpty():
        raise ValueError("no groups to learn from")
    trees: list[Tree] = []
    folded = 0
    for _ in range(rounds):
        tree = Tree((), (), (0.0,))
        for level in range(max(depth, 1)):
            sums = histogram(rows, trees[folded:], tree, edges)
            splits = [best_split(node, smooth, least) if level < depth else None for node in sums]
            if level >= depth - 1:
                # Both sides of a split are sums of the same histogram, so leaves need no pass of their own.
                whole = np.array([node[0].sum(axis=0) for node in sums])
                left = np.array([node[s[0], : s[1] + 1].sum(axis=0) if s else all_ for node, s, all_ in zip(sums, splits, whole, strict=True)])
                ends = np.stack([left, whole - left], axis=1).reshape(-1, 3) if depth else whole
                leaf = tuple((rate * ends[:, 0] / (ends[:, 1] + smooth)).tolist())
            else:
                leaf = (0.0,) * (2 * len(tree.leaf))
            if depth:
                feature = tuple(s[0] if s else 0 for s in splits)
                tree = Tree(tree.feature + feature, tree.bound + tuple(float(s[1]) if s else float("inf") for s in splits), leaf)
            else:
                tree = Tree((), (), leaf)
        trees.append(tree)
        if len(trees) - folded == FOLD and len(trees) < rounds:
            rows = keep(scored_so_far(rows, trees[folded:], edges.shape[0]))
            folded = len(trees)
    return Ranker(tuple(Tree(t.feature, tuple(float(edges[f, int(b)]) if b != float("inf") else b for f, b in zip(t.feature, t.bound, strict=True)), t.leaf) for t in trees))


def ndcg_of(y: str = "y", s: str = "s", k: int = 5) -> Column:
    """NDCG of a group's columns of relevances and scores, by falling score, ties by position."""
    ranked = F.array_sort(F.zip_with(s, F.transform(y, lambda y, i: F.struct(i.alias("i"), y.alias("y"))), lambda s, y: F.struct((-s).alias("s"), y["i"].alias("i"), y["y"].alias("y"))))
    total = lambda ys: F.aggregate(F.transform(F.slice(ys, 1, k), lambda y, i: (F.pow(F.lit(2.0), y) - 1) / F.log2(i + 2.0)), F.lit(0.0), lambda t, v: t + v)
    ideal = total(F.sort_array(y, asc=False))
    return F.try_divide(total(F.transform(ranked, lambda r: r["y"])), ideal)


def ndcg(scored: DataFrame, k: int = 5) -> DataFrame:
    """(group_id, ndcg) of groups (group_id, y, s) with array columns, by falling score, ties by position."""
    return scored.select("group_id", ndcg_of(k=k).alias("ndcg"))


def similar_error(token: Column, errors: Column) -> Column:
    """The first past error (struct original, corrected) whose wrong form is the token or shares its first and last letter, in any case."""
    t = F.lower(token)

    def like(e: Column) -> Column:
        o = F.lower(e["original"])
        return (o != "") & (e["corrected"] != "") & ((o == t) | ((F.left(o, F.lit(1)) == F.left(t, F.lit(1))) & (F.right(o, F.lit(1)) == F.right(t, F.lit(1)))))

    return F.get(F.filter(errors, like), F.lit(0))


def injected(queries: DataFrame, profiles: DataFrame, history: DataFrame, model: Ranker, stop_words: Sequence[str] = (), keywords: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Each query (query_id, user_id, text) with the wrong form that its user is likeliest to write.

    (query_id, clean_query, noisy_query, query_rewritten, selected_token, score, original, corrected, similarity, status): the token of the
    greatest score, the first of equals, takes the form of a resembling past error of its user (history: user_id, errors).  status is
    skipped for queries without content tokens and for users without errors, else success.
    """
    grouped = queries.select("query_id", "user_id", content_tokens(F.col("text"), stop_words).alias("tokens")).where(F.size("tokens") > 0)
    scored = featured(grouped, profiles, keywords).withColumn("s", F.transform("x", model.score))
    best = F.array_max(F.transform("s", lambda s, i: F.struct(s.alias("s"), (-i).alias("i"))))
    chosen = scored.select("query_id", best.alias("b"), "tokens").select("query_id", F.col("b.s").alias("score"), F.get("tokens", -F.col("b.i")).alias("selected_token"))
    out = queries.join(chosen, "query_id", "left").join(history, "user_id", "left").withColumn("hit", similar_error(F.col("selected_token"), F.col("errors")))
    noisy = F.when(F.col("hit").isNotNull(), er.replace_first(F.col("text"), F.col("selected_token"), F.col("hit.original"))).otherwise(F.col("text"))
    return out.select(
        "query_id", F.col("text").alias("clean_query"), noisy.alias("noisy_query"), (noisy != F.col("text")).alias("query_rewritten"), "selected_token",
        F.coalesce("score", F.lit(0.0)).alias("score"), F.col("hit.original").alias("original"), F.col("hit.corrected").alias("corrected"),
        er.char_similarity(F.lower("selected_token"), F.lower("hit.original")).alias("similarity"), F.when(F.col("selected_token").isNull(), "skipped").otherwise("success").alias("status"),
    )
