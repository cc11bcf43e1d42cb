"""Clause structures of parsed texts, their places in sentences, and users' syntax profiles.

Texts come as token arrays (struct i, head, dep, text, is_punct, is_space; token k
stands at place k, a root is its own head).  Structures are found inside the row
by column functions: only tokens that open a structure look for their children.
Profiles merge counts by (user, kind) before maps are built.

Defined cases: null and empty token arrays have no structures; a text whose tokens
are all punctuation or space isn't counted; a head outside the text has no word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as tx

# Words that open an adjectival or a complement clause, in alphabetical order.
ADJECTIVAL_MARKERS = (
    "after", "although", "because", "before", "how", "if", "since", "that", "though", "unless", "until", "what", "whatever", "when", "where",
    "whether", "which", "whichever", "while", "who", "whoever", "whom", "whose", "why",
)
COMPLEMENT_MARKERS = ("if", "that", "what", "whether", "which", "who", "whom", "whose")
#: Labels of children that stand for the relative pronoun.
PRONOUNS = ("nsubj", "dobj", "pobj", "attr")
#: Width in tokens of the bins by which positions meet sentences.
BIN = 64


def _child(kids: Column, t: Column, *deps: str) -> Column:
    """The lower-cased text of the first child of t with one of the labels, among kids."""
    found = F.filter(kids, lambda u: (u["head"] == t["i"]) & (u["i"] != t["i"]) & u["dep"].isin(*deps))
    return F.lower(F.get(found, F.lit(0))["text"])


def _found(tokens: Column, opens: Column, labels: tuple[str, ...], kind, marker, verb) -> Column:
    """Structures of the tokens for which opens(token) holds, by position; kind, marker(kids, token) and verb tell them.  kids, the tokens
    with one of the labels, are bound to a lambda variable, so that a structure looks for its children among these alone."""

    def of(kids: Column) -> Column:
        build = lambda t: F.struct(t["i"].alias("position"), kind(t).alias("kind"), marker(kids, t).alias("marker"), F.get(tokens, t["head"])["text"].alias("head_word"), verb(t).alias("verb_word"))
        return F.array_sort(F.transform(F.filter(tokens, opens), build))

    return tx.bound(F.filter(tokens, lambda u: u["dep"].isin(*labels)), of)


def adjectival(tokens: Column) -> Column:
    """Clauses that widen a tree: acl, relcl, advcl, conj, parataxis and marked ones, by position."""
    head = lambda t: F.get(tokens, t["head"])
    low = lambda t: F.lower(t["text"])
    marked = lambda t: F.when(head(t)["dep"] == "relcl", "relcl_reference").when(head(t)["dep"].isin("advcl", "csubj", "csubjpass"), head(t)["dep"]).otherwise("acl")
    opens = lambda t: t["dep"].isin("acl", "relcl", "advcl", "conj", "parataxis") | ((t["dep"] == "mark") & low(t).isin(*ADJECTIVAL_MARKERS))
    kind = lambda t: F.when(t["dep"] == "mark", marked(t)).when(t["dep"] == "relcl", "relcl_reference").otherwise(t["dep"])
    marker = lambda kids, t: (
        F.when(t["dep"] == "acl", F.coalesce(_child(kids, t, "mark"), _child(kids, t, "comp")))
        .when(t["dep"] == "relcl", F.coalesce(_child(kids, t, *PRONOUNS), low(t)))
        .when(t["dep"] == "advcl", _child(kids, t, "mark"))
        .when(t["dep"] == "mark", low(t))
    )
    verb = lambda t: F.when(t["dep"] == "mark", head(t)["text"]).otherwise(t["text"])
    return _found(tokens, opens, ("mark", "comp", *PRONOUNS), kind, marker, verb)


def complement(tokens: Column) -> Column:
    """Clauses that deepen a tree: ccomp, xcomp, subject clauses and marked ones, by position."""
    head = lambda t: F.get(tokens, t["head"])
    low = lambda t: F.lower(t["text"])
    to = lambda kids, t: F.exists(kids, lambda u: (u["head"] == t["i"]) & (u["i"] != t["i"]) & (u["dep"] == "aux") & (low(u) == "to"))
    opens = lambda t: t["dep"].isin("ccomp", "xcomp", "csubj", "csubjpass") | ((t["dep"] == "mark") & low(t).isin(*COMPLEMENT_MARKERS))
    kind = lambda t: F.when(t["dep"] == "mark", F.concat(F.lit("mark_"), head(t)["dep"])).otherwise(t["dep"])
    marker = lambda kids, t: F.when(t["dep"] == "ccomp", _child(kids, t, "mark")).when(t["dep"] == "xcomp", F.when(to(kids, t), "to").otherwise("bare_infinitive")).when(t["dep"] == "mark", low(t))
    verb = lambda t: F.when(t["dep"] == "mark", head(t)["text"]).otherwise(t["text"])
    return _found(tokens, opens, ("mark", "aux"), kind, marker, verb)


def in_sentences(positions: DataFrame, sentences: DataFrame) -> DataFrame:
    """positions (doc_id, position, ...) with the sentence (doc_id, sentence_index, start, end) that holds each, both ends included.

    An interval join by bins: a sentence goes to each bin that it touches, a position to its own, so both sides are dealt by (document,
    bin) and a long document is spread.  Positions outside all sentences have no row; overlapping sentences give a row each.
    """
    bins = F.explode(F.sequence(F.expr(f"start div {BIN}"), F.expr(f"end div {BIN}")))
    spans = sentences.where("start <= end").select("doc_id", "sentence_index", "start", "end", bins.alias("bin"))
    return positions.withColumn("bin", F.expr(f"position div {BIN}")).join(spans, ["doc_id", "bin"]).where("position BETWEEN start AND end").drop("bin")


def user_structures(texts: DataFrame, find=adjectival) -> DataFrame:
    """A user's profile from texts (user_id, tokens): texts, words, structures, their share and density, gaps between neighbours within
    a text, and how often each kind and marker occurs.

    A text is parsed once: its numbers, gaps, kinds and markers are rows (part, x, v) that are counted by user inside the tasks, so a few
    counts a user are shuffled; means and medians follow from counts.
    """
    words = F.size(F.filter("tokens", lambda t: ~(t["is_punct"] | t["is_space"])))

    def row(part: str, x: Column, v: Column) -> Column:
        return F.struct(F.lit(part).alias("part"), x.cast("string").alias("x"), v.cast("long").alias("v"))

    def parts(found: Column) -> Column:
        none = F.lit(None)
        gaps = F.transform(F.slice(found, F.lit(2), F.greatest(F.size(found) - 1, F.lit(0))), lambda s, k: row("gap", none, s["position"] - F.get(found, k)["position"] - 1))
        kinds, markers = (F.filter(F.transform(found, one), lambda r: r["x"].isNotNull()) for one in (lambda s: row("kind", s["kind"], none), lambda s: row("marker", s["marker"], none)))
        return F.concat(F.array(row("words", none, F.col("words")), row("size", none, F.size(found))), gaps, kinds, markers)

    rows = texts.select("user_id", "tokens", words.alias("words")).where("words > 0")
    each = rows.select("user_id", F.inline(tx.bound(find(F.col("tokens")), parts)))
    counts = each.groupBy("user_id", "part", "x", "v").agg(F.count("*").alias("n"))
    of = lambda part, c: F.when(F.col("part") == part, c)
    n, total = F.col("n"), F.col("n") * F.col("v")
    listed = lambda part: F.map_from_entries(F.array_sort(F.collect_list(of(part, F.struct("x", "n")))))
    out = counts.groupBy("user_id").agg(
        F.sum(of("words", n)).alias("texts"), F.sum(of("words", total)).alias("words"), F.coalesce(F.sum(of("size", F.when(F.col("v") > 0, n))), F.lit(0)).alias("texts_with"),
        F.sum(of("size", total)).alias("structures"), (F.sum(of("gap", total)) / F.sum(of("gap", n))).alias("mean_gap"),
        F.percentile(of("gap", F.col("v")), 0.5, n).alias("median_gap"), listed("kind").alias("kinds"), listed("marker").alias("markers"),
    )
    return out.select(
        "user_id", "texts", "words", "structures", (F.col("texts_with") / F.col("texts")).alias("ratio"), (F.col("structures") / F.col("texts")).alias("per_text"),
        (F.col("words") / F.col("texts")).alias("mean_words"), F.try_divide("words", "structures").alias("words_per_structure"), "mean_gap", "median_gap", "kinds", "markers",
    )


def structure_summary(profiles: DataFrame) -> DataFrame:
    """(name, n, low, high, mean, median) over users for each figure of user_structures(), and (kind:..., n) for each kind's total."""
    names = ("ratio", "per_text", "mean_words", "words_per_structure", "mean_gap", "median_gap")
    figures = profiles.select(F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("x")) for n in names))).alias("f")).select("f.*").where("x IS NOT NULL")
    one = figures.groupBy("name").agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"), F.avg("x").alias("mean"), F.median("x").alias("median"))
    kinds = profiles.select(F.explode("kinds").alias("kind", "n")).groupBy(F.concat(F.lit("kind:"), "kind").alias("name")).agg(F.sum("n").alias("n"))
    return one.unionByName(kinds, allowMissingColumns=True)
