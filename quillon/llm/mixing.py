"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted into cells (source, language, topic) of a contingency
table of words.  Raking scales the cells until their sums match target marginals
of all three dimensions; by default a dimension's targets are its shares raised
to a power under 1, which lifts rare values.  A document is then sampled with a
probability proportional to its cell's factor, cut at 1, whose scale is solved
so that the expected words meet a budget.  Sampling compares a hash of doc_id
with the probability: it is repeatable and independent of partitions.

Topics are learned from the corpus: of the words of five letters or more that
stand between spaces in at most a tenth of the documents, the ``TERMS`` most widespread are
anchors, and a document's topic is the anchor with the largest count times
inverse document frequency (wherever it stands, inflected forms included), or
``other``.

DataFrame functions alone run here.  Words are combined into cells before the
shuffle (a hot source costs one row a task).  Up to TASK_CELLS cells are raked in
one partition, several rounds a job, with windows that need no shuffle there;
beyond, each step sums the cells by one dimension and joins the sums back, by
broadcast where the dimension has no more values than BROADCAST_CELLS, and no
window or task spans all cells.  Both forms give the same fit.  Raking ends once
every marginal is within TOLERANCE of its target, or once BLOCK further rounds
lower the worst distance by less than a tenth: then the targets contradict each
other, and the last dimension's are met.  Cells join documents by their keys; texts are shuffled for that only if there are more
cells than BROADCAST_CELLS, which bounds what is broadcast and changes the plan,
never the result.

Defined cases: null source or language is the value ``unknown``; null and empty
texts have no words, the topic ``other``, and are sampled like their cell; a
value without a target keeps its words, a target without words is left out; a
cell without words keeps factor 1; of anchors that tie, in frequency or in a
text, the one first in order of frequency and alphabet counts; rows of one id
share their draw, rows without an id draw by their text; a very long text counts
by its words like any other; an empty table gives an empty result; other columns,
whatever their names, pass through the stage and are ignored by the query.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.common import cut, rows_of, scratch, table, whole

DIMENSIONS = ("source", "lang", "topic")
#: Powers of the default targets, by dimension.
POWERS = {"source": 0.7, "lang": 0.8, "topic": 0.9}
#: The worst relative distance of a marginal from its target that ends the raking, which is looked at each BLOCK rounds.
TOLERANCE = 0.01
BLOCK = 10
STALLED = 0.9
#: Rounds in one job, where one partition holds all cells: plans get dear to optimise faster than they get long.
CUT = 5
#: Blocks that the SQL form writes out.
SQL_BLOCKS = 6
#: Share of the corpus' words that the sample is expected to hold.
BUDGET = 0.8
#: Anchor terms, the least letters of one, and the largest share of documents that it may stand in.
TERMS = 16
LETTERS = 5
COMMON = 0.1
#: Up to so many cells are broadcast; and so many, at most, are handled by a task.
BROADCAST_CELLS = 50_000
TASK_CELLS = 200_000


def topic_terms(docs: DataFrame, terms: int = TERMS, letters: int = LETTERS, common: float = COMMON) -> list[tuple[str, float]]:
    """The anchors, at most terms of them, with their inverse document frequencies, most widespread first."""
    words = F.array_distinct(F.split(F.coalesce(F.col("text"), F.lit("")), " "))
    n = docs.count()
    dfs = docs.select(F.explode(words).alias("term")).where(F.length("term") >= letters).groupBy("term").agg(F.count("*").alias("df"))
    dfs = dfs.where((F.col("df") <= common * n) & F.col("term").rlike("^\\p{L}+$"))
    return [(r["term"], math.log(n / r["df"])) for r in dfs.orderBy(F.col("df").desc(), "term").limit(terms).collect()]


def with_topic(told: DataFrame, terms: Sequence[tuple[str, float]]) -> DataFrame:
    """told with topic in place of known, a text."""
    if not terms:
        return told.withColumn("topic", F.lit("other")).drop("known")
    known = F.col("known")
    # Columns of their own, so that each text is searched once for each term.
    scores = [(F.length(known) - F.length(F.replace(known, F.lit(term), F.lit("")))) / F.lit(len(term)) * F.lit(idf) for term, idf in terms]
    scored = told.withColumn("scores", F.array(*scores)).withColumn("best", F.array_max("scores"))
    name = F.get(F.array(*(F.lit(term) for term, _ in terms)), (F.array_position("scores", F.col("best")) - 1).cast("int"))
    return scored.withColumn("topic", F.when(F.col("best") > 0, name).otherwise("other")).drop("known", "scores", "best")


def described(docs: DataFrame, terms: Sequence[tuple[str, float]]) -> DataFrame:
    """(d, row, doc_id, draw, words, source, lang, topic): each row of docs whole, its draw in [0, 1) and what places it in a cell."""
    words = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")
    own = [F.col("doc_id"), uniform().alias("draw"), words.alias("words"), *(F.coalesce(F.col(x), F.lit("unknown")).alias(x) for x in ("source", "lang"))]
    told = rows_of(docs, *own, F.coalesce(F.col("text"), F.lit("")).alias("known"))
    return with_topic(told, terms)


def uniform(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """A number in [0, 1) that depends on the id alone, or on the text where there is none."""
    told = F.coalesce(F.col(id_col).cast("string"), F.col(text_col), F.lit(""))
    return F.conv(F.substring(F.md5(told), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def rake(cells: DataFrame, targets: Mapping[str, DataFrame], rounds: int | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """cells (dimensions, words) with fitted added: cell values whose marginals approach the targets.

    targets: for each dimension a DataFrame (value, target).  A value without a target keeps its sum.
    rounds: a fixed number of rounds; without one, blocks of BLOCK until marginals are within tolerance, or stop to come closer.
    """
    parts = 1 + cells.count() // TASK_CELLS
    # Tables, not checkpoints: those would hand on Spark's estimates of size, which every join squares.
    with scratch(cells.sparkSession) as outlive:
        sizes = cells.agg(*(F.countDistinct(name) for name in targets)).first()
        hints = {name: F.broadcast if size <= BROADCAST_CELLS else lambda df: df for name, size in zip(targets, sizes, strict=True)}
        start = cells.withColumn("fitted", F.col("words").cast("double"))
        for name, target in targets.items():
            start = start.join(hints[name](target.select(F.col("value").alias(name), F.col("target").alias(f"to_{name}"))), name, "left")
        fitted = cut(start.coalesce(parts))

        rest = [F.col(c) for c in fitted.columns if c != "fitted"]

        def step(df: DataFrame, name: str) -> DataFrame:
            total = F.sum("fitted")
            if parts == 1:
                total = total.over(Window.partitionBy(name))
            else:
                df, total = df.join(hints[name](df.groupBy(name).agg(total.alias("total"))), name), F.col("total")
            moved = F.when((total > 0) & F.col(f"to_{name}").isNotNull(), F.col("fitted") * F.col(f"to_{name}") / total)
            return df.select(*rest, F.coalesce(moved, F.col("fitted")).alias("fitted"))

        def block(df: DataFrame, length: int) -> DataFrame:
            for k in range(1, length + 1):
                df = df.coalesce(parts) if parts == 1 else df
                for name in targets:
                    df = step(df, name)
                if parts > 1 or k % CUT == 0 or k == length:
                    df = cut(df.coalesce(parts))
            return df

        if rounds is not None:
            fitted = block(fitted, rounds)
        else:
            worst, before = math.inf, math.inf
            while worst > tolerance and (math.isinf(before) or worst <= STALLED * before):
                fitted, before = block(fitted, BLOCK), worst
                worst = marginal_error(fitted, targets)
        return outlive(fitted.select(*cells.columns, "fitted"))


def power_targets(cells: DataFrame, powers: Mapping[str, float]) -> dict[str, DataFrame]:
    """For each dimension (value, target): the corpus' words shared out in proportion to the values' words to a power."""
    out = {}
    total = float(cells.agg(F.sum("words")).first()[0] or 0)
    for name, power in powers.items():
        sums = cut(cells.groupBy(F.col(name).alias("value")).agg(F.pow(F.sum("words").cast("double"), F.lit(power)).alias("lifted")))
        scale = float(sums.agg(F.sum("lifted")).first()[0] or 1) or 1.0
        out[name] = sums.select("value", (F.col("lifted") * F.lit(total) / F.lit(scale)).alias("target"))
    return out


def marginal_error(fitted: DataFrame, targets: Mapping[str, DataFrame]) -> float:
    """The largest relative distance of a fitted marginal from its target."""
    worst = 0.0
    for name, target in targets.items():
        sums = fitted.groupBy(F.col(name).alias("value")).agg(F.sum("fitted").alias("sum")).join(target.where("target > 0"), "value").where("sum > 0")
        worst = max(worst, sums.agg(F.max(F.abs(F.col("sum") / F.col("target") - 1))).first()[0] or 0.0)
    return worst


def probabilities(fitted: DataFrame, budget: float = BUDGET) -> DataFrame:
    """fitted with weight (fitted over words) and probability added: min(1, s * weight), s such that expected words are budget * words.

    s is (budget * all words - words of the cells cut at 1) / (fitted of the others).  Starting without cut cells, it grows until
    no further cell exceeds 1; each step is one sum over the cells.
    """
    weighed = cut(fitted.withColumn("weight", F.when(F.col("words") > 0, F.col("fitted") / F.col("words")).otherwise(F.lit(1.0))))
    scale, known = 0.0, -1
    while True:
        full = F.col("weight") * F.lit(scale) > 1
        sums = [F.sum("words"), F.sum(F.when(full, F.col("words")).otherwise(0)), F.sum(F.when(full, F.lit(0.0)).otherwise(F.col("fitted"))), F.count_if(full)]
        words, cut_words, rest, n = weighed.agg(*sums).first()
        if n == known or not words:
            break
        if not rest > 0:
            scale = math.inf
            break
        known, scale = n, (budget * words - cut_words) / rest
    chosen = F.lit(1.0) if math.isinf(scale) or scale == 0 else F.least(F.lit(1.0), F.col("weight") * F.lit(scale))
    return weighed.withColumn("probability", chosen)


def mix(told: DataFrame, powers: Mapping[str, float] = POWERS, budget: float = BUDGET, rounds: int | None = None) -> DataFrame:
    """told, rows of described(), with weight, probability and sampled added."""
    cells = cut(told.groupBy(*DIMENSIONS).agg(F.sum("words").alias("words")))
    factors = cut(probabilities(rake(cells, power_targets(cells, powers), rounds), budget).select(*DIMENSIONS, "weight", "probability"))
    if factors.count() <= BROADCAST_CELLS:
        factors = F.broadcast(factors)
    return told.join(factors, list(DIMENSIONS)).withColumn("sampled", F.col("draw") < F.col("probability"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    told = cut(described(docs, topic_terms(docs)).select("doc_id", "draw", "words", *DIMENSIONS))
    return mix(told).select(
        "doc_id",
        *DIMENSIONS,
        F.col("words").alias("n_words"),
        F.round("weight", 6).alias("weight"),
        F.round("probability", 6).alias("probability"),
        "sampled",
    )


def sample_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the sampled documents, unchanged."""
    return whole(mix(described(docs, topic_terms(docs))).where("sampled"), docs)


def oracle() -> str:
    """DuckDB SQL for op6_mixing: SQL_BLOCKS blocks of raking rounds written out, which change nothing once a block ended the raking."""
    steps, last = [], "start"
    total = "sum(fitted) OVER (PARTITION BY {0})"
    far = ", ".join(f"CASE WHEN to_{x} > 0 AND {total.format(x)} > 0 THEN abs({total.format(x)} / to_{x} - 1) ELSE 0 END" for x in DIMENSIONS)
    for k in range(SQL_BLOCKS):
        for r in range(BLOCK):
            for name in DIMENSIONS:
                step = f"r{k}_{r}_{name}"
                steps.append(f"{step} AS (SELECT * REPLACE (CASE WHEN NOT done AND {total.format(name)} > 0 THEN fitted * to_{name} / {total.format(name)} ELSE fitted END AS fitted) FROM {last})")
                last = step
        steps.append(f"far{k} AS (SELECT *, greatest({far}) AS away FROM {last})")
        steps.append(f"worst{k} AS MATERIALIZED (SELECT * EXCLUDE (away), max(away) OVER () AS now FROM far{k})")
        steps.append(f"b{k} AS (SELECT * EXCLUDE (now) REPLACE (now <= {TOLERANCE} OR (worst < 'inf'::DOUBLE AND now > {STALLED} * worst) AS done, now AS worst) FROM worst{k})")
        last = f"b{k}"
    target = ", ".join(f"t_{x} AS (SELECT {x}, pow(sum(words)::DOUBLE, {POWERS[x]}) AS lifted FROM cells GROUP BY {x})" for x in DIMENSIONS)
    lifted = ", ".join(f"t_{x}.lifted * (SELECT sum(words)::DOUBLE FROM cells) / (SELECT sum(lifted) FROM t_{x}) AS to_{x}" for x in DIMENSIONS)
    joins = " ".join(f"JOIN t_{x} USING ({x})" for x in DIMENSIONS)
    return f"""
WITH counted AS (
  SELECT row_number() OVER () AS r, doc_id, text, coalesce(source, 'unknown') AS source, coalesce(lang, 'unknown') AS lang, coalesce(text, '') AS known,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_words
  FROM documents),
held AS (SELECT unnest(list_distinct(string_split(known, ' '))) AS term FROM counted),
dfs AS (SELECT term, count(*) AS df FROM held WHERE regexp_full_match(term, '\\p{{L}}{{{LETTERS},}}') GROUP BY term HAVING count(*) <= {COMMON} * (SELECT count(*) FROM counted)),
terms AS (SELECT term, ln((SELECT count(*) FROM counted) / df::DOUBLE) AS idf, row_number() OVER (ORDER BY df DESC, term) AS place FROM dfs QUALIFY place <= {TERMS}),
scores AS (SELECT r, term, place, (length(known) - length(replace(known, term, '')))::DOUBLE / length(term) * idf AS score FROM counted, terms),
topics AS (SELECT r, arg_max(term, (score, -place)) AS topic FROM scores WHERE score > 0 GROUP BY r),
told AS (SELECT doc_id, text, source, lang, n_words, coalesce(topic, 'other') AS topic FROM counted LEFT JOIN topics USING (r)),
cells AS (SELECT source, lang, topic, sum(n_words) AS words FROM told GROUP BY ALL),
{target},
start AS (SELECT cells.source, cells.lang, cells.topic, words, words::DOUBLE AS fitted, false AS done, 'inf'::DOUBLE AS worst, {lifted} FROM cells {joins}),
{", ".join(steps)},
weighed AS (SELECT source, lang, topic, words, fitted, CASE WHEN words > 0 THEN fitted / words ELSE 1.0 END AS weight FROM {last}),
scaled AS (
  SELECT *, CASE WHEN words > 0 THEN ({BUDGET} * (SELECT sum(words)::DOUBLE FROM weighed) - coalesce(sum(words) OVER upto, 0))
    / ((SELECT sum(fitted) FROM weighed) - coalesce(sum(fitted) OVER upto, 0)) END AS scale
  FROM weighed WINDOW upto AS (ORDER BY weight DESC, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
chosen AS (SELECT coalesce(max(scale), 1.0) AS s FROM scaled WHERE scale * weight <= 1 AND scale >= 0),
factors AS (SELECT source, lang, topic, weight, least(1.0, weight * s) AS probability FROM weighed, chosen)
SELECT doc_id, source, lang, topic, n_words, round(weight, 6) AS weight, round(probability, 6) AS probability,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, text, '')), 1, 12))::BIGINT::DOUBLE / {1 << 48} < probability AS sampled
FROM told JOIN factors USING (source, lang, topic)"""
