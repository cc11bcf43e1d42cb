"""Text functions as Column expressions.  Null input gives null unless a docstring says otherwise."""

from __future__ import annotations

import html as html_lib
from collections.abc import Callable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Suffixes of the light stemmer, in the order they are tried.
STEM_SUFFIXES = ("ingly", "edly", "ing", "ed", "en", "ly", "ness", "ment", "er", "est", "al", "ic", "ish")
# Texts that stand for a missing attribute, and for a missing brand.
PLACEHOLDERS = ("none", "n/a", "na", "null", "unknown", "see description")
NO_BRANDS = ("unknown", "generic", "n/a", "na", "none", "null", "")
# Characters that brands lose at both ends.
BRAND_EDGES = " \" .*+,-_!@#$%^&*();\\/|<>'\t\n\r"
# Fixed value: marks that product types lose at the end.
TYPE_ENDS = ",，。.!?;："
# Characters whose upper case in Java is several characters: those with a capital of one character, and that; those that stay.
_MANY = [c for c in map(chr, range(0x80, 0x10000)) if not 0xD800 <= ord(c) <= 0xDFFF and len(c.upper()) > 1]
_TITLED = {c: "\u1e9e" if c == "\u00df" else c.title() for c in _MANY if c == "\u00df" or (len(c.title()) == 1 and c.title() != c)}
_EXPANDING = "".join(_TITLED), "".join(_TITLED.values())
_KEPT = "".join(c for c in _MANY if c not in _TITLED)
# Fixed value: what counts as a query token.
QUERY_TOKEN = "[a-zA-Z0-9]+(?:'[a-zA-Z0-9]+)*"


def bound(value: Column, function: Callable[[Column], Column]) -> Column:
    """function of value, which is bound to a lambda variable, so that it is computed once a row however often function names it."""
    return F.get(F.transform(F.array(value), function), F.lit(0))


def words(text: Column) -> Column:
    """Words between white space; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def sentences(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "(?<=[.!?])\\s+")


def count_long_sentences(text: Column, low: int, high: int) -> Column:
    """Sentences of low to high words."""
    return F.size(F.filter(sentences(text), lambda s: word_count(s).between(low, high)))


def query_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(QUERY_TOKEN), F.lit(0))


def search_tokens(text: Column) -> Column:
    """Lower-cased letter and digit runs, as indexed for retrieval."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def upper(text: Column) -> Column:
    """text in upper case, each character by one character, as DuckDB's upper() does: the sharp s gives its capital, not SS."""
    one = F.translate(text, _EXPANDING[0], _EXPANDING[1])
    parts = F.regexp_extract_all(one, F.lit(f"[{_KEPT}]+|[^{_KEPT}]+"), F.lit(0))
    whole = F.array_join(F.transform(parts, lambda p: F.when(p.rlike(f"^[{_KEPT}]"), p).otherwise(F.upper(p))), "")
    return F.when(one.rlike(f"[{_KEPT}]"), whole).otherwise(F.upper(one))


def price(text: Column) -> Column:
    """The first number, commas and a trailing dot removed; null if there is none."""
    number = F.translate(F.regexp_extract(text, "\\$?([\\d,]+\\.?\\d*)", 1), ",", "")
    return F.nullif(F.regexp_replace(number, "\\.+$", ""), F.lit(""))


def price_in_text(text: Column) -> Column:
    """The first amount after a dollar sign, else before the word dollar(s) or usd."""
    signed = F.nullif(F.regexp_extract(text, "\\$([\\d,]+\\.?\\d*)", 1), F.lit(""))
    # Only digits and one dot before the word: of "1,299 usd" that is 299.
    named = F.nullif(F.regexp_extract(text, "(?i)(\\d+\\.?\\d*)\\s*(?:dollars?|usd)", 1), F.lit(""))
    return price(F.coalesce(signed, named))


def product_type(categories: Column) -> Column:
    """The last category of 3 to 50 characters (else the one before); of parts joined by & the first of the longest; null if nothing is left."""
    last, second = F.try_element_at(categories, F.lit(-1)), F.try_element_at(categories, F.lit(-2))
    fits = lambda c: F.length(c).between(3, 50)
    chosen = F.when(fits(last), last).when(fits(second), second)
    part = F.btrim(longest(F.split(chosen, " & ")))
    return F.nullif(F.btrim(F.regexp_replace(part, f"[{TYPE_ENDS}]+$", "")), F.lit(""))


def first_keyword(text: Column, keywords: list[str]) -> Column:
    """The longest keyword (list order on ties) that the lower-cased text contains."""
    ordered = sorted(keywords, key=lambda k: -len(k))
    out = F.lit(None).cast("string")
    for word in reversed(ordered):
        out = F.when(F.lower(text).contains(word.lower()), F.lit(word)).otherwise(out)
    return out


def capitalized(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 1 << 30)))


def keyword_set(text: Column, keywords: list[str]) -> Column:
    """Keywords among the text's words, in keyword order."""
    return F.array_intersect(F.array(*map(F.lit, keywords)), F.split(F.lower(text), "\\s+"))


def longest(values: Column) -> Column:
    """The first of the longest strings of an array."""
    return F.reduce(values, F.lit(None).cast("string"), lambda best, v: F.when(best.isNull() | (F.length(v) > F.length(best)), v).otherwise(best))


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "\\s+", " "))


def is_placeholder(text: Column) -> Column:
    return F.lower(squeezed(text)).isin(*PLACEHOLDERS)


def canonical_attribute(text: Column) -> Column:
    """Squeezed, and cut at the first ( if something stands before it."""

    def cut(clean: Column) -> Column:
        head = F.trim(F.substring_index(clean, "(", 1))
        return F.when(clean.contains("(") & (head != ""), head).otherwise(clean)

    return bound(squeezed(text), cut)


def scalar_attribute(text: Column) -> Column:
    """The part before the first ; (else the first ,), canonical; null for placeholders and blanks."""
    part = F.when(text.contains(";"), F.substring_index(text, ";", 1)).otherwise(F.substring_index(text, ",", 1))
    return bound(canonical_attribute(part), lambda clean: F.when(~is_placeholder(clean) & (clean != ""), clean))


def attribute_identity(text: Column) -> Column:
    """NUM:: and the plain number, or TEXT:: and the lower-cased text: 19.90 and 19.9 are the same."""
    clean = F.trim(text)
    number = clean.try_cast("decimal(38,18)").cast("string")
    plain = F.regexp_replace(F.regexp_replace(number, "(\\.\\d*?)0+$", "$1"), "\\.$", "")
    return F.coalesce(F.concat(F.lit("NUM::"), plain), F.concat(F.lit("TEXT::"), F.lower(clean)))


def stem(token: Column) -> Column:
    """A light stemmer: plural endings, then the first matching suffix that leaves three letters."""
    t = F.lower(token)
    n = F.length(t)
    cut = lambda k: n - F.lit(k)
    plural = (
        F.when((n > 4) & t.endswith("ies"), F.concat(F.substring(t, F.lit(1), cut(3)), F.lit("y")))
        .when((n > 3) & t.endswith("es") & ~(t.endswith("aes") | t.endswith("ees") | t.endswith("oes")), F.substring(t, F.lit(1), cut(2)))
        .when((n > 3) & t.endswith("s") & ~t.endswith("ss"), F.substring(t, F.lit(1), cut(1)))
        .otherwise(t)
    )
    out = plural
    for suffix in reversed(STEM_SUFFIXES):
        out = F.when(plural.endswith(suffix) & (F.length(plural) - len(suffix) >= 3), F.substring(plural, F.lit(1), F.length(plural) - len(suffix))).otherwise(out)
    return out


def compacted(text: Column) -> Column:
    """One-line form of a document: line breaks to sentence breaks, then doubled marks and spaces removed, in this order."""
    t = F.replace(F.replace(text, F.lit("\n"), F.lit(". ")), F.lit("\r"), F.lit(""))
    t = F.replace(t, F.lit("- "), F.lit(""))
    t = F.replace(F.replace(t, F.lit(": ."), F.lit(":")), F.lit("ios:"), F.lit(":"))
    t = F.replace(F.regexp_replace(t, "\\s{2,}", " "), F.lit(".. "), F.lit(". "))
    return F.trim(t)


def clean_brand(brand: Column) -> Column:
    b = F.btrim(F.coalesce(brand, F.lit("")), F.lit(BRAND_EDGES))
    b = F.regexp_replace(F.regexp_replace(F.regexp_replace(b, "^by ", ""), "\\.com$", ""), "^www\\.", "")
    return F.trim(F.when(F.length(b) > 100, F.substring_index(b, " ", 1)).otherwise(b))


def first_difference(clean: Column, noisy: Column) -> Column:
    """struct(correct_word, error_word) of the first word that differs, if word counts agree and both hold a letter or digit."""
    pairs = F.arrays_zip(words(clean).alias("correct_word"), words(noisy).alias("error_word"))
    usable = lambda p: (p["correct_word"] != p["error_word"]) & p["correct_word"].rlike("[A-Za-z0-9]") & p["error_word"].rlike("[A-Za-z0-9]")
    return F.when(word_count(clean) == word_count(noisy), F.get(F.filter(pairs, usable), F.lit(0)))


def occurrences(text: Column, value: Column) -> Column:
    """Letter-bounded, case-insensitive occurrences of value in text."""
    quoted = F.concat(F.lit("(?i)(?<![A-Za-z])\\Q"), value, F.lit("\\E(?![A-Za-z])"))
    return F.regexp_count(text, quoted)


def duration(seconds: Column) -> Column:
    """3661 -> 1h 1m 1s; 125 -> 2m 5s; 9 -> 9s."""
    s = seconds.cast("long")
    h, m, r = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60))
    return F.when(h > 0, F.format_string("%dh %dm %ds", h, m, r)).when(m > 0, F.format_string("%dm %ds", m, r)).otherwise(F.format_string("%ds", r))


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag: str) -> None:
        self.hidden -= tag in ("script", "style") and self.hidden > 0

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.parts.append(data)


def _visible(page: str | None) -> str:
    parser = _Text()
    parser.feed(page or "")
    parser.close()
    return " ".join(" ".join(parser.parts).split())


@F.pandas_udf(StringType())
def html_text(pages: pd.Series) -> pd.Series:
    """The visible text of HTML pages, white space squeezed."""
    return pages.map(_visible)


@F.pandas_udf(StringType())
def unescaped(texts: pd.Series) -> pd.Series:
    """HTML entities decoded."""
    return texts.map(lambda t: None if t is None else html_lib.unescape(t))
