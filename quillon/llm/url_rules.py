"""URL filters: fixed host/path rules, and association rules mined with FP-growth.

A url becomes a set of tokens (host labels by depth, registered part, path
words, file kind, query keys).  Spark's FP-growth mines the token combinations
that go with a bad label, and those that go with a good one; rules are kept by
support, confidence and significance, corrected for the number of combinations
that were tried, and a rule that a shorter one of its kind implies at no less
confidence is dropped.  Matching uses an inverted index: a url's tokens meet the
rules' tokens, and a rule fires when all its tokens have been counted.

Before mining, tokens that stand in exactly the same labelled urls are merged
into one (scheme, top level and site of a single-site corpus, say), and tokens of
all urls or of too few are left out: such tokens tell nothing apart, and all
subsets of them would be itemsets.  Spark's FP-growth has no bound of length:
itemsets of over max_tokens tokens are mined and then left out, so the time to
mine doubles with each further token that frequent urls have in common.  The
rules that stay are few whatever the number of urls: at most the mean over urls
of the number of their combinations of up to max_tokens tokens, divided by the
support; so the index is small and is shipped to the tasks, and scoring shuffles
nothing.  Pruning by shorter rules is a join of the rules.
Fitting reads all labelled urls; FP-growth combines equal branches before it
shuffles, so a hot host costs few rows.

Defined cases: null urls and urls without ``://`` have an empty host and path,
no tokens and the default verdict allow; urls that no rule fits are allowed; of
several rules the most significant decides, ties go to the higher confidence,
then support, then name; without labels, or with an empty table of pages, there
are no rules; repeated rows and rows of one or no id are judged alike, each by
its own url; a very long url has as many tokens as it has different parts; other
columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from statistics import NormalDist

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import ASCII_LOWER, ASCII_UPPER, arrow_map, cut, table

# Verdict, host suffix, path prefix.
FIXED_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
BAD, GOOD = "label=bad", "label=good"
MIN_SUPPORT = 0.002
MIN_CONFIDENCE = 0.3
#: Chance that any rule at all is kept where labels don't depend on urls (Bonferroni over the combinations tried).
ALPHA = 0.05
MAX_TOKENS = 3
#: A rule rests on so many urls of its label at least, however few are labelled.
MIN_HITS = 20


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or the end, A-Z lower-cased; path: from there up to ?, # or the end."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.coalesce(F.regexp_extract(rest, "(?s)^([^/?#]*)", 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, "(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))
    return F.translate(host, ASCII_UPPER, ASCII_LOWER), path


def fixed_verdict(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = FIXED_RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, suffix, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == suffix) | host.endswith("." + suffix)) & path.startswith(prefix)
        out = F.when(fits, F.struct(F.lit(suffix + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def url_tokens(url: str | None) -> list[str]:
    """The distinct tokens of one url, in sorted order."""
    if not url or "://" not in url:
        return []
    scheme, rest = url.split("://", 1)
    host, path, query = re.match(r"([^/?#]*)([^?#]*)(.*)", rest, re.DOTALL).groups()
    labels = host.lower().split(":")[0].split(".")
    found = {"scheme=" + scheme.lower(), "tld=" + labels[-1], f"depth={path.count('/')}"}
    found |= {"host=" + x for x in labels[:-1] if x}
    if len(labels) > 2:
        found.add("site=" + ".".join(labels[-3:]))
    for word in re.split(r"[/._\-]+", path.lower()):
        if word:
            found.add(f"digits={len(word)}" if word.isdigit() else "path=" + word)
    found |= {"query=" + x.split("=", 1)[0] for x in re.split(r"[?&#]", query) if x}
    return sorted(found)


def tokens_of(urls: DataFrame, id_col: str, url_col: str) -> DataFrame:
    """(key, tokens) for each row."""

    def of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        tokens = pa.array([url_tokens(u) for u in batch.column("url").to_pylist()], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([batch.column("key"), tokens], names=["key", "tokens"])

    return arrow_map(urls.select(F.col(id_col).cast("long").alias("key"), F.col(url_col).cast("string").alias("url")), of, "key long, tokens array<string>")


@dataclass(frozen=True)
class UrlRule:
    tokens: tuple[str, ...]
    support: float
    confidence: float
    verdict: str = "block"
    #: Standard errors by which the confidence exceeds the label's overall share.
    sigmas: float = 0.0

    @property
    def name(self) -> str:
        return "&".join(self.tokens)


def telling_tokens(rows: DataFrame, n: int, least: int) -> DataFrame:
    """(token) of rows (tokens): one for each set of urls that a token of at least least of the n urls, but not of all, stands in."""
    # Numbered before tokens become rows: beside an explode the number would be that of a token.
    each = rows.select(F.xxhash64(F.monotonically_increasing_id()).alias("url"), "tokens").select("url", F.explode("tokens").alias("token"))
    told = each.groupBy("token").agg(F.count("*").alias("freq"), F.sum(F.col("url").cast("decimal(38,0)")).alias("urls")).where((F.col("freq") >= least) & (F.col("freq") < n))
    return told.groupBy("freq", "urls").agg(F.min("token").alias("token")).select("token")


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, max_tokens: int = MAX_TOKENS, alpha: float = ALPHA, min_hits: int = MIN_HITS) -> list[UrlRule]:
    """Rules for bad and for good urls from columns tokens (array) and bad (boolean; null rows are left out), the most significant first."""
    rows = cut(labelled.where("bad is not null and size(tokens) > 0").select("tokens", "bad"))
    n, n_bad = rows.agg(F.count("*"), F.count_if("bad")).first()
    if n < min_hits or n_bad in (0, n):
        return []
    least = max(min_hits, math.ceil(min_support * n))
    told = telling_tokens(rows, n, least)
    # At most (tokens of a url) / min_support tokens are frequent; one row, shipped as such.
    held = told.agg(F.collect_list("token")).first()[0]
    label = F.when(F.col("bad"), F.lit(BAD)).otherwise(F.lit(GOOD))
    items = cut(rows.select(F.array_append(F.array_intersect("tokens", F.array(*map(F.lit, held)).cast("array<string>")), label).alias("items")))
    frequent = FPGrowth(itemsCol="items", minSupport=least / n, minConfidence=1.0).fit(items).freqItemsets
    labels = F.array(F.lit(BAD), F.lit(GOOD))
    own = frequent.select(F.array_sort(F.array_except("items", labels)).alias("tokens"), F.get(F.array_intersect("items", labels), F.lit(0)).alias("label"), "freq")
    own = cut(own.where(F.size("tokens").between(1, max_tokens)))
    tried = own.where("label is not null").count()
    if not tried:
        return []
    hits = own.where("label is not null").withColumnRenamed("freq", "hits")
    both = hits.join(own.where("label is null").select("tokens", "freq"), "tokens")
    base = F.when(F.col("label") == BAD, n_bad / n).otherwise(1 - n_bad / n)
    scored = both.withColumn("confidence", F.col("hits") / F.col("freq")).withColumn("sigmas", (F.col("confidence") - base) / F.sqrt(base * (1 - base) / F.col("freq")))
    needed = NormalDist().inv_cdf(1 - alpha / tried)
    strong = cut(scored.where((F.col("confidence") >= min_confidence) & (F.col("sigmas") >= needed)))
    found = pruned(strong, max_tokens).select("tokens", "label", (F.col("hits") / n).alias("support"), "confidence", "sigmas").collect()
    rules = [UrlRule(tuple(r["tokens"]), r["support"], r["confidence"], "block" if r["label"] == BAD else "allow", r["sigmas"]) for r in found]
    return sorted(rules, key=lambda r: (-r.sigmas, -r.confidence, -r.support, r.name))


def _chosen(tokens: Column, mask: int) -> Column:
    """The tokens at the places of mask's bits."""
    places = [k for k in range(mask.bit_length()) if mask >> k & 1]
    return F.filter(tokens, lambda _, i: i.isin(*places))


def pruned(rules: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """rules (tokens, label, confidence, ...) without those that hold a shorter rule of their label of at least their confidence."""
    parts = [_chosen(F.col("tokens"), mask) for mask in range(1, (1 << max_tokens) - 1)]
    each = rules.select("label", F.col("tokens").alias("whole"), F.col("confidence").alias("own"), F.explode(F.array_distinct(F.array(*parts))).alias("tokens"))
    each = each.where((F.size("tokens") > 0) & (F.size("tokens") < F.size("whole")))
    implied = each.join(rules.select("label", "tokens", "confidence"), ["label", "tokens"]).where("confidence >= own").select("label", F.col("whole").alias("tokens")).distinct()
    return rules.join(implied, ["label", "tokens"], "left_anti")


class RuleIndex:
    """An inverted index from token to the rules that hold it."""

    def __init__(self, rules: Sequence[UrlRule]):
        self.rules = list(rules)
        self.sizes = [len(r.tokens) for r in self.rules]
        self.postings: dict[str, list[int]] = {}
        for number, rule in enumerate(self.rules):
            for token in rule.tokens:
                self.postings.setdefault(token, []).append(number)

    def match(self, tokens: Sequence[str]) -> int:
        """The first rule (the most significant) whose tokens are all among the given distinct ones; -1 if none."""
        seen: dict[int, int] = {}
        best = -1
        for token in tokens:
            for number in self.postings.get(token, ()):
                count = seen[number] = seen.get(number, 0) + 1
                if count == self.sizes[number] and (best < 0 or number < best):
                    best = number
        return best


def judge(urls: DataFrame, rules: Sequence[UrlRule], fixed: Sequence[tuple[str, str, str]] = FIXED_RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id_col, host, path, rule, verdict, mined_rule, confidence) for each row."""
    index = RuleIndex(rules)
    host, path = host_and_path(F.col(url_col))
    told = urls.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), host.alias("host"), path.alias("path"))
    told = told.withColumn("fixed", fixed_verdict(F.col("host"), F.col("path"), fixed))
    told = told.select("page_id", "url", "host", "path", "fixed.rule", "fixed.verdict")

    def of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        best = [index.match(url_tokens(u)) for u in batch.column("url").to_pylist()]
        fired = [index.rules[k] if k >= 0 else None for k in best]
        columns = [batch.column(x) for x in ("page_id", "host", "path", "rule", "verdict")]
        columns += [pa.array([r and r.name for r in fired], pa.string()), pa.array([r and r.confidence for r in fired], pa.float64()), pa.array([r and r.verdict for r in fired], pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["page_id", "host", "path", "rule", "verdict", "mined_rule", "confidence", "own"])

    schema = "page_id long, host string, path string, rule string, verdict string, mined_rule string, confidence double, own string"
    judged = arrow_map(told, of, schema)
    verdict = F.coalesce("verdict", "own", F.lit("allow"))
    return judged.withColumn("verdict", verdict).drop("own").withColumnRenamed("page_id", id_col)


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(tokens, bad): a page's url ends in the number of the document it shows; that document's quality 0 makes it bad."""
    number = F.regexp_extract("url", "://[^?#]*/([0-9]{1,18})", 1).try_cast("long")
    keyed = tokens_of(pages.select(number.alias("doc_id"), "url"), "doc_id", "url").where("key is not null")
    known = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").alias("key")).agg((F.min("quality") == 0).alias("bad"))
    return keyed.join(known, "key").select("tokens", "bad")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    rules = mine(labelled_urls(pages, table(spark, sf_dir, "labels")))
    return judge(pages, rules)
