"""Writing-error predicates and scores as Column expressions over words and pairs of words."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Verb and pronoun pairs (either order) and affixes that don't count as errors.
VERB_PAIRS = (("was", "were"), ("is", "are"), ("do", "did"), ("does", "did"))
PRONOUN_PAIRS = (("i", "me"), ("he", "him"), ("she", "her"), ("we", "us"), ("they", "them"))
AFFIXES = ("s", "es", "ed", "ing", "er", "est", "ly", "d", "en", "n")
# Look-alike letters, and letter groups that mark phonetic errors.
VISUAL_LETTERS = (("m", "n"), ("b", "d"), ("p", "q"), ("i", "l"), ("o", "e"), ("a", "e"), ("u", "v"), ("g", "q"))
VISUAL_PARTS = (("m", "n"), ("b", "d"), ("p", "q"), ("i", "l"), ("o", "e"), ("ae", "e"), ("ve", "y"), ("our", "or"), ("ere", "are"))
PHONETIC_PARTS = ("ei", "ie", "ough", "ight", "tle", "ple", "ble", "dle", "kel", "cel")
# Neighbours of each key.
KEY_NEIGHBOURS = {
    "q": "wa", "w": "qeas", "e": "wrds", "r": "etfd", "t": "rygf", "y": "tuhg", "u": "yijh", "i": "uokj", "o": "iplk", "p": "ol",
    "a": "qwsz", "s": "wedxza", "d": "erfcxs", "f": "rtgvcd", "g": "tyhbvf", "h": "yujnbg", "j": "uikmnh", "k": "iolmj", "l": "opk",
    "z": "asx", "x": "sdcz", "c": "dfvx", "v": "fgbc", "b": "ghnv", "n": "hjmb", "m": "jkn",
}
# Colour and size words.
COLOURS = ("red", "blue", "green", "white", "black", "pink", "purple", "orange", "yellow", "brown", "gray", "grey", "gold", "silver")
SIZES = ("small", "medium", "large", "mini", "miniature", "compact", "tiny", "big", "xl", "xxl", "xs")
# Weights of a token's score.
WEIGHTS = {"similarity": 0.35, "chars": 0.20, "bigrams": 0.15, "surface": 0.15, "attribute": 0.15}


def any_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts)


def chars(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), ""), lambda c: c != "")


def bigrams(text: Column) -> Column:
    t = F.lower(text)
    n = F.length(t)
    return F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(t, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))


def without_apostrophes(text: Column) -> Column:
    return F.translate(text, "'’‘", "")


def pair_class(original: Column, corrected: Column) -> Column:
    """Why a correction is trivial (space_diff, punct_only, verb_variation, pronoun_variation, affix_variation) or unusable
    (empty, identity, multi_word); the empty string for a real error."""
    o, c = F.lower(F.trim(F.coalesce(original, F.lit("")))), F.lower(F.trim(F.coalesce(corrected, F.lit(""))))
    bare_o, bare_c = without_apostrophes(o), without_apostrophes(c)
    either = lambda pairs: any_of([((o == a) & (c == b)) | ((o == b) & (c == a)) for a, b in pairs])
    short, long = F.when(F.length(o) > F.length(c), c).otherwise(o), F.when(F.length(o) > F.length(c), o).otherwise(c)
    affixed = (F.length(short) >= 3) & any_of([long == F.concat(short, F.lit(a)) for a in AFFIXES])
    return (
        F.when((o == "") | (c == ""), "empty")
        .when(o == c, "identity")
        .when(F.replace(o, F.lit(" "), F.lit("")) == F.replace(c, F.lit(" "), F.lit("")), "space_diff")
        .when(o.rlike("\\s") | c.rlike("\\s"), "multi_word")
        .when((bare_o == bare_c) | ((bare_c != "") & bare_o.startswith(bare_c) & (F.length(bare_o) > F.length(bare_c))), "punct_only")
        .when(either(VERB_PAIRS), "verb_variation")
        .when(either(PRONOUN_PAIRS), "pronoun_variation")
        .when(affixed, "affix_variation")
        .otherwise("")
    )


def is_suffix_change(a: Column, b: Column) -> Column:
    return (a != b) & (a.endswith(b) | b.endswith(a))


def is_punctuation_change(a: Column, b: Column) -> Column:
    bare = lambda x: F.regexp_replace(x, "[^\\p{Alnum}]", "")
    return (a != b) & (bare(a) == bare(b))


def is_apostrophe_change(a: Column, b: Column) -> Column:
    return (a != b) & (without_apostrophes(a) == without_apostrophes(b))


def is_case_change(a: Column, b: Column) -> Column:
    return (a != b) & (F.lower(a) == F.lower(b))


def char_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of the sets of lower-cased characters; 0 if both are empty."""
    x, y = F.array_distinct(chars(a)), F.array_distinct(chars(b))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)).cast("double"), F.size(F.array_union(x, y))), F.lit(0.0))


def substring_distance(a: Column, b: Column) -> Column:
    """0.3 of the length ratio if b lies in a, 0.5 of it if a lies in b, else edit distance over the longer length; 1 if one is empty."""
    n, m = F.length(a).cast("double"), F.length(b).cast("double")
    return (
        F.when((n == 0) | (m == 0), F.lit(1.0))
        .when(F.contains(a, b), F.lit(0.3) * m / n)
        .when(F.contains(b, a), F.lit(0.5) * n / m)
        .otherwise(F.levenshtein(a, b) / F.greatest(n, m))
    )


def _differences(a: Column, b: Column) -> Column:
    both = F.arrays_zip(chars(a).alias("x"), chars(b).alias("y"), F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1))).alias("i"))
    return F.filter(both, lambda p: p["x"] != p["y"])


def is_transposition(a: Column, b: Column) -> Column:
    d = _differences(a, b)
    p, q = F.get(d, F.lit(0)), F.get(d, F.lit(1))
    swapped = (p["i"] + 1 == q["i"]) & (p["x"] == q["y"]) & (p["y"] == q["x"])
    return (F.length(a) == F.length(b)) & (F.size(d) == 2) & F.coalesce(swapped, F.lit(False))


def is_visually_similar(a: Column, b: Column) -> Column:
    d = _differences(a, b)
    alike = F.array(*(F.lit(x + y) for pair in VISUAL_LETTERS for x, y in (pair, pair[::-1])))
    return (F.length(a) == F.length(b)) & (F.size(d) > 0) & F.forall(d, lambda p: F.array_contains(alike, F.concat(p["x"], p["y"])))


def is_keyboard_slip(a: Column, b: Column) -> Column:
    """One or two letters differ, each by a neighbouring key."""
    d = _differences(a, b)
    near = F.array(*(F.lit(k + n) for k, ns in KEY_NEIGHBOURS.items() for n in ns))
    return (F.length(a) == F.length(b)) & F.size(d).between(1, 2) & F.forall(d, lambda p: F.array_contains(near, F.concat(p["x"], p["y"])) | F.array_contains(near, F.concat(p["y"], p["x"])))


def error_type(original: Column, corrected: Column) -> Column:
    """phonetic, visual or spelling."""
    o, c = F.lower(original), F.lower(corrected)
    phonetic = any_of([o.contains(p) | c.contains(p) for p in PHONETIC_PARTS])
    visual = any_of([(o.contains(a) & c.contains(b)) | (o.contains(b) & c.contains(a)) for a, b in VISUAL_PARTS])
    return F.when(phonetic, "phonetic").when(visual, "visual").otherwise("spelling")


def surface_difficulty(token: Column) -> Column:
    flag = lambda c, x: F.when(c, F.lit(x)).otherwise(F.lit(0.0))
    n = F.length(token)
    total = (
        F.least(n * F.lit(0.05), F.lit(0.3))
        + flag(token.rlike("[0-9]"), 0.2)
        + flag(token.rlike("[A-Z]"), 0.1)
        + flag(token.rlike("(.)\\1"), 0.1)
        + flag(token.rlike("(?i)[wxqz]"), 0.1)
        + flag(~token.rlike("(?i)[aeiou][^aeiou]|[^aeiou][aeiou]") & (n > 3), 0.1)
    )
    return F.when(n > 0, F.least(total, F.lit(1.0))).otherwise(F.lit(0.0))


def attribute_risk(token: Column, values: Column) -> Column:
    """values: array of attribute texts; the first that equals or holds the token counts."""
    flag = lambda c, x: F.when(c, F.lit(x)).otherwise(F.lit(0.0))
    low = F.lower(token)
    hit = F.get(F.filter(values, lambda v: F.contains(F.lower(v), low)), F.lit(0))
    total = (
        F.when(F.lower(hit) == low, F.lit(0.3)).when(hit.isNotNull(), F.lit(0.2)).otherwise(F.lit(0.0))
        + flag(token.rlike("^[A-Z]") & token.rlike("[a-z]"), 0.15)
        + flag(token.rlike("[0-9]"), 0.2)
        + flag(low.isin(*COLOURS), 0.15)
        + flag(low.isin(*SIZES), 0.1)
    )
    return F.least(total, F.lit(1.0))


def greatest_count(freq: Column) -> Column:
    return F.array_max(F.map_values(freq)).cast("double")


def error_char_score(token: Column, freq: Column, top: Column | None = None) -> Column:
    """freq: map from character to how often the user's errors touch it; top: its greatest_count where that is known."""
    top = greatest_count(freq) if top is None else top

    def score(t: Column) -> Column:
        cs, known, letters = t["cs"], t["known"], t["letters"]
        boost = F.aggregate(known, F.lit(0.0), lambda total, c: total + (F.element_at(freq, c) / t["top"]) * (F.size(F.filter(cs, lambda x: x == c)) / letters))
        return F.when((letters > 0) & (F.size(freq) > 0), F.least(F.size(known) / letters + boost * 0.5, F.lit(1.0))).otherwise(F.lit(0.0))

    # Bound to a lambda variable, so that a token is taken apart once and not for each of its characters.
    cs = chars(token)
    letters = F.size(F.filter(cs, lambda c: c.rlike("\\p{L}"))).cast("double")
    parts = F.struct(cs.alias("cs"), F.filter(cs, lambda c: F.map_contains_key(freq, c)).alias("known"), letters.alias("letters"), top.alias("top"))
    return F.get(F.transform(F.array(parts), score), F.lit(0))


def error_bigram_score(token: Column, freq: Column, top: Column | None = None) -> Column:
    top = greatest_count(freq) if top is None else top

    def score(t: Column) -> Column:
        bs = t["bs"]
        total = F.aggregate(bs, F.lit(0.0), lambda total, b: total + F.coalesce(F.try_element_at(freq, b) / t["top"], F.lit(0.0)))
        return F.when((F.size(bs) > 0) & (F.size(freq) > 0), F.least(total / F.size(bs), F.lit(1.0))).otherwise(F.lit(0.0))

    return F.get(F.transform(F.array(F.struct(bigrams(token).alias("bs"), top.alias("top"))), score), F.lit(0))


def token_score(token: Column, error_words: Column, char_freq: Column, bigram_freq: Column, values: Column) -> Column:
    similarity = F.coalesce(F.array_max(F.transform(error_words, lambda e: char_similarity(token, e))), F.lit(0.0))
    return (
        WEIGHTS["similarity"] * similarity
        + WEIGHTS["chars"] * error_char_score(token, char_freq)
        + WEIGHTS["bigrams"] * error_bigram_score(token, bigram_freq)
        + WEIGHTS["surface"] * surface_difficulty(token)
        + WEIGHTS["attribute"] * attribute_risk(token, values)
    )


def matches_error(token: Column, original: Column) -> Column:
    """Whether a past error's wrong form resembles token: same first and last letter, one edit, a swap, a look-alike or a key slip."""
    t, o = F.lower(token), F.lower(original)
    bt, bo = without_apostrophes(t), without_apostrophes(o)
    ends = (F.length(bt) >= 2) & (F.length(bo) >= 2) & (F.abs(F.length(bt) - F.length(bo)) <= 2) & (F.substring(bt, 1, 1) == F.substring(bo, 1, 1)) & (F.right(bt, F.lit(1)) == F.right(bo, F.lit(1)))
    long = F.length(t) >= 2
    return (o != "") & (ends | (F.levenshtein(bt, bo) == 1) | (long & (is_transposition(t, o) | is_visually_similar(t, o) | is_keyboard_slip(t, o))))


def replace_first(text: Column, word: Column, by: Column) -> Column:
    """text with the first letter-bounded, case-insensitive occurrence of word replaced; text itself without one."""
    at = F.regexp_instr(text, F.concat(F.lit("(?i)(?<![A-Za-z])\\Q"), word, F.lit("\\E(?![A-Za-z])")))
    return F.when(at > 0, F.overlay(text, by, at, F.length(word))).otherwise(text)
