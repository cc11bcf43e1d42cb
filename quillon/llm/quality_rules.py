"""Quality rules: text statistics and a hashed n-gram log-likelihood ratio.

Base statistics are column expressions over a text.  The method scores each
document by the mean, over its word unigrams and bigrams, of the log-ratio of
two multinomials over hashed buckets: one of trusted texts, one of the whole
corpus.  The trusted multinomial is smoothed towards the corpus, so n-grams that
it hasn't seen lower a score by a bounded amount.  Weights are fixed-point
integers, so sums don't depend on the order of rows.

DataFrame functions alone run here.  Counts cover all documents, in one pass for
the corpus and the trusted texts, and are combined into at most 2 * buckets rows
for each task before the shuffle; the weights (4 * 2 * buckets numbers, a
parameter) reach the tasks as one array; a document's n-grams are summed inside
its row.  The trusted texts are those of all documents labelled good.  A trusted
document is scored without its own n-grams (its counts are taken out of the
trusted ones inside the row), so it is judged like one that was not labelled; the
threshold is a low quantile of these left-out ratios.  Texts are scored once: the
narrow result is written before the quantile is taken from it.  Trusted ids are
broadcast up to ``MAX_BROADCAST`` of them, beyond which rows are joined by shuffle.

Words of repeated 3-word windows are found inside the row: each window's hash
(high 34 bits) and position (low 30 bits, more than a text has words) share a
long, and sorting the longs brings equal windows together.  Matches of the first
hash are confirmed by a second, independent one.

Defined cases: null and empty texts have no words, fail the base rules and
score 0; every row is judged by its own text, also where its id is null or
repeated; a row with a null id or a repeated label is no more trusted than its
label says (null ids never are, an id with any label 1 is); a row that repeats a
trusted id leaves out its own counts alone; a ratio that equals the threshold
passes; without trusted rows all ratios are 0 and pass; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import cut, space_words, table

BUCKETS = 1 << 16
#: Trusted ids that are broadcast at most.
MAX_BROADCAST = 2_000_000
#: Pseudo-counts, with the corpus' proportions, added to the trusted counts.
PRIOR = 50_000.0
#: Documents whose mean log-ratio is under this fail, where no threshold is learned.
THRESHOLD = -0.25
#: Share of the trusted documents past the base rules that a learned threshold fails.
LOST = 0.01
MIN_WORDS = 50
MAX_REPEATED = 0.5
_SCALE = 1e6
#: Parts that a range of values is cut into for a quantile, a row each.
BINS = 1000
#: Bits of a window's position: a text of 2**31 bytes, the most a row can hold, has at most 2**30 words.
_AT = 30


def repeat_positions(words: Column) -> Column:
    """Sorted starts (from 0) of the 3-word windows found twice or more among words."""

    def coded(starts: Column, salt: int) -> Column:
        return F.sort_array(F.transform(starts, lambda i: F.shiftleft(F.xxhash64(F.lit(salt), F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)), _AT).bitwiseOR(i.cast("long"))))

    def twins(codes: Column) -> Column:
        def same(code: Column, i: Column) -> Column:
            head = F.shiftright(code, _AT)
            return F.coalesce(head == F.shiftright(F.get(codes, i + 1), _AT), F.lit(False)) | F.coalesce(head == F.shiftright(F.get(codes, i - 1), _AT), F.lit(False))

        return F.transform(F.filter(codes, same), lambda code: code.bitwiseAND(F.lit((1 << _AT) - 1)).cast("int"))

    windows = F.size(words) - 2
    none = F.array().cast("array<int>")
    starts = F.when(windows > 1, F.sequence(F.lit(0), windows - 1)).otherwise(none)
    # Bound to lambda variables, so that the sorted arrays are built once for each text.
    first = F.flatten(F.transform(F.array(coded(starts, 1)), twins))
    second = F.flatten(F.transform(F.array(first), lambda found: F.flatten(F.transform(F.array(coded(found, 2)), twins))))
    return F.sort_array(second)


def covered(starts: Column) -> Column:
    """How many words the 3-word windows at the sorted starts cover."""
    ends = F.transform(starts, lambda s, i: F.least(F.coalesce(F.get(starts, i + 1) - s, F.lit(3)), F.lit(3)))
    return F.aggregate(ends, F.lit(0).cast("long"), lambda total, n: total + n)


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held: Column | None = None, **more: Callable[[Column, Column | None], Column]) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed) for each row, and more columns, functions of its
    words and of held, a constant."""
    flags = [c for c in docs.columns if c == "own"]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *flags, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if held is not None:
        rows = rows.withColumn("held", held)

    def told(row: Column) -> Column:
        w, text = row["w"], row["text"]
        lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
        once = lambda array, function: F.get(F.transform(F.array(array), function), F.lit(0))
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
            once(lines, lambda own: F.size(own) - F.size(F.array_distinct(own))).cast("long").alias("n_dup_lines"),
            once(repeat_positions(w), covered).alias("n_repeat_words"),
            *(function(w, row["held"] if held is not None else None).alias(name) for name, function in more.items()),
        )

    # A text's words and held are bound to one lambda variable, so that the words are built once.  A subquery may not be written into a
    # lambda function; as a column that is used once the optimizer puts it there, and it is never copied into a row.
    bound = F.struct(space_words(F.col("text")).alias("w"), "text", *(["held"] if held is not None else []))
    out = rows.select("doc_id", F.get(F.transform(F.array(bound), told), F.lit(0)).alias("told")).select("doc_id", "told.*")
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")))


def bucket(*words: Column, buckets: int = BUCKETS) -> Column:
    """The bucket of a word, or (after those of single words) of a pair."""
    own = F.pmod(F.xxhash64(*words), F.lit(buckets))
    return (own if len(words) == 1 else F.lit(buckets) + own).cast("int")


def gram_buckets(words: Column, buckets: int = BUCKETS) -> Column:
    """The buckets of a text's words, then those of its pairs of neighbours."""
    pairs = F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0)))
    return F.concat(F.transform(words, lambda w: bucket(w, buckets=buckets)), F.transform(pairs, lambda w, i: bucket(F.get(words, i), w, buckets=buckets)))


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS, text_col: str = "text") -> DataFrame:
    """(bucket, n): how often each bucket occurs; with a flag own among the columns also m, how often in rows that have it set."""
    flag = F.coalesce(F.col("own"), F.lit(False)) if "own" in docs.columns else F.lit(False)
    words = docs.select(space_words(F.col(text_col)).alias("w"), flag.alias("own"))
    # Words are exploded and then hashed: outside of lambda functions hashing is compiled.
    zipped = F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))).alias("b"))
    each = words.select("own", F.explode(zipped).alias("g"))
    pair = F.when(F.col("g.b").isNotNull(), bucket(F.col("g.a"), F.col("g.b"), buckets=buckets))
    found = each.select("own", F.explode(F.array(bucket(F.col("g.a"), buckets=buckets), pair)).alias("bucket")).where("bucket is not null")
    return found.groupBy("bucket").agg(F.count("*").alias("n"), F.count_if("own").alias("m"))


def weights(docs: DataFrame, trusted: DataFrame | None = None, buckets: int = BUCKETS, prior: float = PRIOR, text_col: str = "text") -> DataFrame:
    """(bucket, weight, left, n, m): log-ratio of the trusted to the corpus multinomial, in millionths, for buckets that occur; the same
    without one trusted n-gram and without the logarithm of the trusted total; corpus and trusted counts.

    The trusted rows are those of trusted, or without it those of docs whose flag own is set.
    """
    counts = cut(bucket_counts(docs, buckets, text_col))
    if trusted is not None:
        good = cut(bucket_counts(trusted, buckets, text_col)).select("bucket", F.col("n").alias("m"))
        counts = cut(counts.drop("m").join(good, "bucket", "left").withColumn("m", F.coalesce("m", F.lit(0))))
    n_raw, n_good = (x or 0 for x in counts.agg(F.sum("n"), F.sum("m")).first())
    share = F.col("n") / F.lit(float(max(n_raw, 1)))
    smoothed = (F.col("m") + F.lit(prior) * share) / F.lit(n_good + prior)
    others = F.greatest(F.col("m") - 1, F.lit(0)) + F.lit(prior) * share
    millionths = lambda ratio: F.round(F.log(ratio) * _SCALE).cast("long")
    return counts.select("bucket", millionths(smoothed / share).alias("weight"), millionths(others / share).alias("left"), "n", "m")


def weight_array(bucket_weights: DataFrame, buckets: int = BUCKETS, names: Sequence[str] = ("weight",)) -> Column:
    """The named columns one behind the other as one array, each by bucket, 0 where a bucket doesn't occur: 2 * buckets numbers a column,
    a parameter, however large the corpus.  It is a scalar subquery: a literal would stand in full in every description of a plan."""
    every = bucket_weights.sparkSession.range(2 * buckets).select(F.col("id").cast("int").alias("bucket")).join(bucket_weights, "bucket", "left")
    pairs = F.array_sort(F.collect_list(F.struct("bucket", *(F.coalesce(name, F.lit(0)).alias(name) for name in names))))

    def one(name: str) -> Column:
        return F.transform(pairs, lambda p: p[name].cast("long"))

    return every.agg(F.concat(*map(one, names)).alias("held")).scalar()


def likelihood_ratio(grams: Column, held: Column) -> Column:
    """The mean of held (weights by bucket) over the buckets of a text's n-grams; 0 without any."""
    total = F.aggregate(grams, F.lit(0).cast("long"), lambda total, gram: total + F.get(held, gram))
    return F.when(F.size(grams) > 0, total / F.size(grams) / _SCALE).otherwise(0.0)


def left_out_ratio(grams: Column, held: Column, n_raw: int, n_good: int, buckets: int = BUCKETS, prior: float = PRIOR) -> Column:
    """likelihood_ratio of a trusted text, its own n-grams taken out of the trusted counts; held has weight, left, n and m by bucket.

    Most buckets occur once in a text, for which left is the weight; those that occur again are sorted out and mended.
    """
    size, width, zero = F.size(grams), 2 * buckets, F.lit(0).cast("long")
    once = F.aggregate(grams, zero, lambda total, gram: total + F.get(held, gram + width))

    def mended(again: Column) -> Column:
        def mend(total: Column, gram: Column, many: Column) -> Column:
            least = F.lit(prior / max(n_raw, 1)) * F.get(held, gram + 2 * width)
            good = F.get(held, gram + 3 * width)
            more = F.log((F.greatest(good - many, F.lit(0)) + least) / (F.greatest(good - 1, F.lit(0)) + least))
            return total + many * F.round(more * _SCALE).cast("long")

        def step(at: Column, i: Column) -> Column:
            # Equal buckets are runs, each short of its first; the last of a run mends it.
            gram, many = F.get(again, i), at["run"] + 1
            last = ~gram.eqNullSafe(F.get(again, i + 1))
            return F.struct(F.when(last, mend(at["total"], gram, many)).otherwise(at["total"]).alias("total"), F.when(last, F.lit(1)).otherwise(many).cast("long").alias("run"))

        start = F.struct(zero.alias("total"), F.lit(1).cast("long").alias("run"))
        places = F.when(F.size(again) > 0, F.sequence(F.lit(0), F.size(again) - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(places, start, step, lambda at: at["total"])

    # Bound to lambda variables, so that the arrays are built once for each text.
    twice = F.flatten(F.transform(F.array(F.sort_array(grams)), lambda own: F.filter(own, lambda gram, i: gram.eqNullSafe(F.get(own, i - 1)))))
    more = F.get(F.transform(F.array(twice), mended), F.lit(0))
    return F.when(size > 0, (once + more) / size / _SCALE - F.log(F.lit(n_good + prior) - size)).otherwise(0.0)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """The doc_ids labelled quality 1, all of them."""
    return labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()


def quantile(values: DataFrame, share: float) -> float | None:
    """The share's quantile of column x, between neighbours by their distance; None without values.

    A place is found by counting values in BINS ranges, then in those of the range that holds it: BINS rows come back each time.
    """
    counts = values.where("x is not null")
    n = counts.count()
    if not n:
        return None
    at = share * (n - 1)
    low = _nth(counts, int(at))
    high = _nth(counts, min(int(at) + 1, n - 1)) if at > int(at) else low
    return low + (high - low) * (at - int(at))


def _nth(values: DataFrame, k: int) -> float:
    """The value at place k (from 0) of column x in order: ranges that hold it are cut in BINS until it holds one value alone."""
    low, high = values.agg(F.min("x"), F.max("x")).first()
    while low < high:
        width = (high - low) / BINS
        part = F.least(F.floor((F.col("x") - F.lit(low)) / F.lit(width)), F.lit(BINS - 1)) if width > 0 else F.lit(0)
        found = sorted(values.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).collect())
        for row in found:
            if k < row["n"]:
                break
            k -= row["n"]
        values = values.where((F.col("x") >= F.lit(row["low"])) & (F.col("x") <= F.lit(row["high"])))
        if (row["low"], row["high"]) == (low, high):
            break  # neighbouring numbers: none lies between
        low, high = row["low"], row["high"]
    return low if low == high or k < values.where(F.col("x") == F.lit(low)).count() else high


def judge(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, prior: float = PRIOR, threshold: float | None = THRESHOLD, own: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr, kept) for each row of docs (columns doc_id, text).

    own: the distinct doc_ids of the rows that trusted holds, any number; these rows' own counts are left out of their ratios.
    With own, a threshold of None is learned: the quantile LOST of the ratios of the trusted rows past the base rules.
    """
    if own is None:
        held = weight_array(cut(weights(docs, trusted, buckets, prior)), buckets)
        judged = statistics(docs, held=held, llr=lambda words, held: _of(words, held, buckets, likelihood_ratio))
        return judged.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))
    marked = own.select("doc_id", F.lit(True).alias("own"))
    if marked.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST:
        marked = F.broadcast(marked)
    joined = docs.select("doc_id", "text").join(marked, "doc_id", "left")
    found = cut(weights(joined, None, buckets, prior))
    n_raw, n_good = (x or 0 for x in found.agg(F.sum("n"), F.sum("m")).first())
    held = weight_array(found, buckets, ("weight", "left", "n", "m"))

    def ratio(words: Column, held: Column | None) -> Column:
        return _of(words, held, buckets, lambda grams, held: F.when(F.col("own"), left_out_ratio(grams, held, n_raw, n_good, buckets, prior)).otherwise(likelihood_ratio(grams, held)))

    judged = cut(statistics(joined, held=held, llr=ratio, known=lambda words, held: F.coalesce(F.col("own"), F.lit(False))))
    if threshold is None:
        threshold = quantile(judged.where("known and not base_failed").select(F.col("llr").alias("x")), LOST)
    passed = F.lit(True) if threshold is None else F.col("llr") >= threshold
    return judged.drop("known").withColumn("kept", ~F.col("base_failed") & passed)


def _of(words: Column, held: Column, buckets: int, function: Callable[[Column, Column], Column]) -> Column:
    """function of a text's buckets and of held; the buckets are bound to a lambda variable, so that they are built once a text."""
    return F.get(F.transform(F.array(gram_buckets(words, buckets)), lambda grams: function(grams, held)), F.lit(0))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    own = cut(trusted_ids(table(spark, sf_dir, "labels")))
    return judge(docs, docs, threshold=None, own=own)
