"""Product documents: dimensions, reviews, questions, related products and the assembled text.

Products are (asin, title, brand, rank, description, feature, reviews, qa, also_buy, also_view): feature, also_buy and
also_view arrays of strings, reviews an array of struct(summary, text, vote), qa one of struct(question, answer).  Arrays
keep the source's order.  Null or empty parts leave their line out; a product without a title is an Unnamed Product.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as tx

# Where sizes and weights stand, tried in this order.
RANK_SIZE = r"Product Dimensions:\s*([^;]+)"
SIZES = (r"(?i)(\d+(?:\.\d+)?\s*x\s*\d+(?:\.\d+)?\s*x\s*\d+(?:\.\d+)?\s*(?:inches|in|cm|mm))", r"(?i)Dimensions:\s*([\d.x\s]+(?:inches|in|cm)?)")
WEIGHTS = (r"(?i)(\d+(?:\.\d+)?\s*(?:pounds|lbs|oz|grams|kg))", r"(?i)Weight:\s*([\d.]+\s*(?:pounds|lbs|oz|grams|kg)?)")
# Entries of a document (the entry at the limit still counts), and related products of each kind.
ENTRIES, RELATED = 25, 3


def _first(text: Column, patterns: tuple[str, ...]) -> Column:
    return F.coalesce(*(F.nullif(F.btrim(F.regexp_extract(text, p, 1), F.lit(" \t\r\n")), F.lit("")) for p in patterns))


def dimensions(rank: Column, description: Column) -> Column:
    """The size named in rank, else the first in the description; null if there is none."""
    return F.coalesce(_first(rank, (RANK_SIZE,)), _first(description, SIZES))


def weight(description: Column) -> Column:
    return _first(description, WEIGHTS)


def plain_features(features: Column) -> Column:
    """Features without tags, white space squeezed; those that are empty or name an asin go."""
    kept = F.filter(features, lambda f: f.isNotNull() & (f != "") & ~F.lower(f).contains("asin"))
    return F.transform(kept, lambda f: tx.squeezed(F.regexp_replace(f, "<[^>]+>", "")))


def review_text(reviews: Column, entries: int = ENTRIES) -> Column:
    """Reviews as sentences, most votes first (source order on ties); votes that aren't whole numbers count as none."""
    votes = lambda r: F.coalesce(F.translate(r["vote"], ",", "").try_cast("long"), F.lit(0))
    keyed = F.transform(reviews, lambda r, i: F.struct((-votes(r)).alias("v"), i.alias("i"), r.alias("r")))
    said = lambda k: F.concat(F.lit('The review "'), F.coalesce(k["r"]["summary"], F.lit("")), F.lit('" states that "'), F.coalesce(k["r"]["text"], F.lit("")), F.lit('". '))
    return F.array_join(F.transform(F.slice(F.array_sort(keyed), 1, entries + 1), said), "")


def question_text(qa: Column, entries: int = ENTRIES) -> Column:
    said = lambda q: F.concat(F.lit('The question is "'), F.coalesce(q["question"], F.lit("")), F.lit('", and the answer is "'), F.coalesce(q["answer"], F.lit("")), F.lit('". '))
    return F.array_join(F.transform(F.slice(qa, 1, entries + 1), said), "")


def related_titles(products: DataFrame, n: int = RELATED) -> DataFrame:
    """(asin, bought, viewed): titles of the first n products of also_buy and also_view as numbered lines.

    Numbers are places in the list, so products that aren't known leave gaps.  One join and one grouping serve both lists;
    a group holds at most 2 n titles.  A product that many others name is the join's hot key on the exploded side, which
    adaptive execution splits, since titles are written to it unaggregated.
    """
    listed = lambda c: F.transform(F.slice(F.coalesce(F.col(c), F.array().cast("array<string>")), 1, n), lambda a, i: F.struct(F.lit(c).alias("kind"), (i + 1).alias("place"), a.alias("other")))
    each = products.select("asin", F.inline(F.concat(listed("also_buy"), listed("also_view"))))
    titles = products.select(F.col("asin").alias("other"), F.coalesce("title", F.lit("Unknown")).alias("name"))
    line = F.struct("place", F.concat(F.lit("#"), F.col("place").cast("string"), F.lit(": "), F.col("name"), F.lit("\n")).alias("line"))
    lines = lambda kind: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, line))), lambda s: s["line"]), "")
    return each.join(titles, "other").groupBy("asin").agg(lines("also_buy").alias("bought"), lines("also_view").alias("viewed"))


def relation_text(bought: Column, viewed: Column, brand: Column) -> Column:
    part = lambda head, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(head), c)).otherwise("")
    rows = F.concat(part("  products also purchased: \n", bought), part("  products also viewed: \n", viewed), part("  brand: ", F.concat(F.nullif(brand, F.lit("")), F.lit("\n"))))
    return part("- relations:\n", rows)


def product_documents(products: DataFrame, relations: bool = True, compact: bool = False, entries: int = ENTRIES) -> DataFrame:
    """(asin, document).  HTML entities of reviews and questions are decoded; entries 0 leaves both out.  asin is unique."""
    line = lambda head, c, end="\n": F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(head), c, F.lit(end))).otherwise("")
    numbered = F.array_join(F.transform(plain_features(F.col("feature")), lambda f, i: F.concat(F.lit("#"), (i + 1).cast("string"), F.lit(": "), f, F.lit("\n"))), "")
    parts = [
        F.concat(F.lit("- product: "), F.coalesce("title", F.lit("Unnamed Product")), F.lit("\n")), line("- brand: ", F.col("brand")),
        line("- dimensions: ", dimensions(F.col("rank"), F.col("description"))), line("- weight: ", weight(F.col("description"))),
        line("- description: ", F.col("description")), line("- features: \n", numbered, ""),
    ]
    if entries > 0:
        parts += [line("- reviews: ", tx.unescaped(review_text(F.col("reviews"), entries))), line("- Q&A: ", tx.unescaped(question_text(F.col("qa"), entries)))]
    rows = products
    if relations:
        rows = products.join(related_titles(products), "asin", "left")
        parts.append(relation_text(F.col("bought"), F.col("viewed"), F.col("brand")))
    document = F.concat(*parts)
    return rows.select("asin", (tx.compacted(document) if compact else document).alias("document"))


def picked_attributes(slots: list[tuple[str, Column]], most: int = 5) -> Column:
    """array of struct(key, value): for each slot (key, array of texts) in order the first usable value whose identity no
    earlier slot has taken, until most slots are filled."""
    held = "struct<used:array<string>,picked:array<struct<key:string,value:string>>>"
    listed = F.array(*(F.struct(F.lit(key).alias("key"), values.cast("array<string>").alias("values")) for key, values in slots))
    identity = lambda v: tx.attribute_identity(tx.canonical_attribute(v))

    def told(value: Column) -> Column:
        return tx.bound(tx.scalar_attribute(value), lambda v: F.when(v.isNotNull(), F.struct(v.alias("value"), identity(v).alias("identity"))))

    def add(so_far: Column, slot: Column) -> Column:
        def grown(first: Column) -> Column:
            taken = F.array(F.struct(slot["key"].alias("key"), first["value"].alias("value")))
            more = F.struct(F.concat(so_far["used"], F.array(first["identity"])).alias("used"), F.concat(so_far["picked"], taken).alias("picked"))
            return F.when(first.isNotNull(), more.cast(held)).otherwise(so_far)

        # Values and identities are bound, so that each is worked out once; slots past the last that counts aren't looked at.
        usable = F.array_compact(F.transform(slot["values"], told))
        first = F.get(F.filter(usable, lambda v: ~F.array_contains(so_far["used"], v["identity"])), F.lit(0))
        return F.when(F.size(so_far["picked"]) < most, tx.bound(first, grown)).otherwise(so_far)

    start = F.struct(F.array().cast("array<string>").alias("used"), F.array().cast("array<struct<key:string,value:string>>").alias("picked")).cast(held)
    return F.reduce(listed, start, add, lambda s: s["picked"])


def target_depth(mean: Column) -> Column:
    """The nearest whole depth, halves to the even one; null for anything below 1 or not finite."""
    whole = F.when(~F.isnan(mean) & (F.abs(mean) < 1e9), F.bround(mean).cast("int"))
    return F.when(whole >= 1, whole)
