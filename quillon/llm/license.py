"""License scans by diagonal voting.

Every word bigram of every document is hashed and joined with the hashed
bigrams of the templates, a fixed table small by construction.  A match at
document word p and template word t votes for the diagonal p - t, after the
words themselves are compared.  Votes are aggregated by document, template and
diagonal before any window is taken; neighbouring diagonals (words inserted or
left out) merge, and a merged span counts when it covers enough of the template
within a bounded length.  Base phrases count only complete diagonals.

DataFrame functions alone run here.  Row counts after the join are those of the
votes; sums meet by (row, template, diagonal), so a hot line or a very common
bigram is combined before it is shuffled.

Defined cases: null and empty texts have no words and no labels (empty string,
score 0, null positions); texts of one word have no bigram; each repeated place
counts; every row is judged by its own text, also where its id is null or
repeated; positions are 32-bit, more than any text has words; of equally good
spans all are listed and the score is the best coverage; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.common import ASCII_LOWER, ASCII_UPPER, cut, table

#: What separates words: ASCII characters other than digits and letters.
GAPS = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
_TRIM = "".join(chr(c) for c in range(0x80) if not chr(c).isalnum())

# The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Wording of public license notices and of whole short licenses, and labels of this scan's own.
TEMPLATES = {
    "this work is licensed under the gnu general public license version 3": "gpl-notice",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl-notice",
    "licensed under the apache license version 2 0": "apache-2.0",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under a creative commons attribution 4 0 international license": "cc-by-notice",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "this source code form is subject to the terms of the mozilla public license": "mpl-2.0",
    "this work has been released into the public domain": "public-domain",
    """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
    the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish
    distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to
    the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial
    portions of the software the software is provided as is without warranty of any kind express or implied including but not limited
    to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or
    copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising
    from out of or in connection with the software or the use or other dealings in the software""": "mit-text",
    """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that
    the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims
    all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the
    author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data
    or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or
    performance of this software""": "isc-text",
    """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions
    are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
    redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the
    documentation and or other materials provided with the distribution this software is provided by the copyright holders and
    contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and
    fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct
    indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or
    services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract
    strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of
    the possibility of such damage""": "bsd-text",
    """this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages
    arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial
    applications and to alter it and redistribute it freely subject to the following restrictions the origin of this software must not
    be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in
    the product documentation would be appreciated but is not required altered source versions must be plainly marked as such and must
    not be misrepresented as being the original software this notice may not be removed or altered from any source
    distribution""": "zlib-text",
    """this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or
    distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any
    means""": "unlicense-text",
    """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may
    obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing
    software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express
    or implied see the license for the specific language governing permissions and limitations under the license""": "apache-2.0-text",
}
# English function words; a bigram of two of them says little and isn't looked for in templates.
FUNCTION_WORDS = frozenset("a an and any are as be by for from if in is it no not of on or that the this to was were will with you your".split())
#: Share of a template's bigrams that a merged span must hold, how far apart merging diagonals may lie, and the longest span relative to the template.
COVERAGE = 0.7
DRIFT = 2
STRETCH = 1.5


def license_words(text: Column) -> Column:
    """The text's words, A-Z not yet lower-cased (that doesn't move their borders)."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(_TRIM))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, GAPS))


def gram_rows(base: Mapping[str, str], templates: Mapping[str, str]) -> list[tuple]:
    """(template, label, is_base, n_grams, size, t, ta, tb): one row for each bigram of each template; templates leave out those of two function words."""
    rows = []
    for number, (phrase, label) in enumerate([*base.items(), *templates.items()]):
        words, is_base = phrase.split(), number < len(base)
        held = [t for t in range(len(words) - 1) if is_base or not {words[t], words[t + 1]} <= FUNCTION_WORDS]
        if not held:
            raise ValueError(f"a template needs two words: {phrase!r}")
        rows += [(number, label, is_base, len(held), len(words), t, words[t], words[t + 1]) for t in held]
    return rows


def template_grams(spark: SparkSession, base: Mapping[str, str], templates: Mapping[str, str]) -> DataFrame:
    """gram_rows with the hash of each bigram."""
    grams = spark.createDataFrame(gram_rows(base, templates), "template int, label string, is_base boolean, n_grams int, size int, t int, ta string, tb string")
    return grams.withColumn("gram", F.xxhash64("ta", "tb"))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, k, h, w): each row's id and words under a key of its own.

    What a scan finds depends on the text alone, so rows of equal id and equal text may share a key, and no others do:
    k is the id (0 for null), h a hash of the text.
    """
    doc_id = F.col(id_col).cast("long")
    return docs.select(doc_id.alias("id"), F.coalesce(doc_id, F.lit(0)).alias("k"), F.xxhash64(F.col(text_col)).alias("h"), license_words(F.col(text_col)).alias("w"))


def votes(keys: DataFrame, base: Mapping[str, str], templates: Mapping[str, str]) -> DataFrame:
    """(k, h, template, label, is_base, n_grams, size, diagonal, seen): seen are the template positions matched on a diagonal."""
    pairs = keys.where(F.size("w") > 1).select("k", "h", F.posexplode(F.arrays_zip(F.slice("w", 1, F.size("w") - 1).alias("a"), F.slice("w", 2, F.size("w")).alias("b"))).alias("p", "g"))
    grams = pairs.select("k", "h", "p", F.col("g.a").alias("a"), F.col("g.b").alias("b")).withColumn("gram", F.xxhash64(F.lower("a"), F.lower("b")))
    # Broadcast: as many rows as the templates, a fixed list, have bigrams.
    hits = grams.join(F.broadcast(template_grams(keys.sparkSession, base, templates)), "gram")
    same = [F.translate(x, ASCII_UPPER, ASCII_LOWER) == F.col(y) for x, y in (("a", "ta"), ("b", "tb"))]
    hits = hits.where(same[0] & same[1]).withColumn("diagonal", F.col("p") - F.col("t"))
    return hits.groupBy("k", "h", "template", "label", "is_base", "n_grams", "size", "diagonal").agg(F.collect_set("t").alias("seen"))


def spans(found: DataFrame, coverage: float = COVERAGE, drift: int = DRIFT, stretch: float = STRETCH) -> DataFrame:
    """(k, h, label, is_base, first, until, covered): verified spans, word positions first to until (exclusive).

    Each diagonal of a base phrase is a run of its own and must be complete; a template's diagonals merge.
    """
    own = Window.partitionBy("k", "h", "template").orderBy("diagonal")
    apart = F.col("is_base") | (F.col("diagonal") - F.lag("diagonal", 1).over(own) > drift)
    runs = found.withColumn("starts", F.coalesce(apart.cast("int"), F.lit(0))).withColumn("run", F.sum("starts").over(own))
    merged = runs.groupBy("k", "h", "template", "label", "is_base", "n_grams", "size", "run").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("seen")))).alias("n_seen"),
        F.min(F.col("diagonal") + F.array_min("seen")).alias("first"),
        F.max(F.col("diagonal") + F.array_max("seen") + 2).alias("until"),
    )
    merged = merged.withColumn("covered", F.col("n_seen") / F.col("n_grams"))
    loose = (F.col("covered") >= coverage) & (F.col("until") - F.col("first") <= stretch * F.col("size"))
    return merged.where(F.when(F.col("is_base"), F.col("n_seen") == F.col("n_grams")).otherwise(loose)).select("k", "h", "label", "is_base", "first", "until", "covered")


def scan(docs: DataFrame, base: Mapping[str, str] = BASE, templates: Mapping[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_words, base counts and places, labels, best coverage and the spans themselves."""
    keys = keyed(docs, id_col, text_col)
    found = spans(votes(keys, base, templates))
    only = F.when(F.col("is_base"), F.col("first"))
    # Written before rows are joined with it, so that Spark may split the join of a text that very many rows of one id hold.
    named = cut(
        found.groupBy("k", "h").agg(
            F.count(only).alias("n_base"),
            F.min(only).cast("long").alias("first_word"),
            F.max(only).cast("long").alias("last_word"),
            F.array_join(F.sort_array(F.collect_set(F.when(F.col("is_base"), F.col("label")))), ",").alias("base_labels"),
            F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"),
            F.max("covered").alias("score"),
            F.sort_array(F.collect_list(F.struct("first", "until", "label", "covered"))).alias("spans"),
        )
    )
    sizes = keys.select("id", "k", "h", F.size("w").cast("long").alias("n_words"))
    none = F.array().cast("array<struct<first:int,until:int,label:string,covered:double>>")
    return sizes.join(named, ["k", "h"], "left").select(
        F.col("id").alias("doc_id"),
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        F.coalesce("spans", none).alias("spans"),
    )


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("spans")


def oracle() -> str:
    """DuckDB SQL for op10_license_scan: the words themselves are joined instead of their hashes."""
    rows = [f"({template}, '{label}', {is_base}, {n}, {size}, {at}, '{a}', '{b}')" for template, label, is_base, n, size, at, a, b in gram_rows(BASE, TEMPLATES)]
    return f"""
WITH grams(template, label, is_base, n_grams, size, t, a, b) AS (VALUES {", ".join(rows)}),
docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{ASCII_UPPER}', '{ASCII_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
pairs AS (SELECT r, unnest(range(0, len(w) - 1)) AS p, unnest(w[:-2]) AS a, unnest(w[2:]) AS b FROM docs WHERE len(w) > 1),
found AS (SELECT r, template, label, is_base, n_grams, size, p - t AS diagonal, list(DISTINCT t) AS seen FROM pairs JOIN grams USING (a, b) GROUP BY ALL),
marked AS (SELECT *, coalesce(is_base OR diagonal - lag(diagonal) OVER own > {DRIFT}, false)::INT AS starts FROM found WINDOW own AS (PARTITION BY r, template ORDER BY diagonal)),
runs AS (SELECT *, sum(starts) OVER (PARTITION BY r, template ORDER BY diagonal) AS run FROM marked),
merged AS (SELECT r, label, is_base, n_grams, size, len(list_distinct(flatten(list(seen)))) AS n_seen, min(diagonal + list_min(seen)) AS first, max(diagonal + list_max(seen) + 2) AS until FROM runs GROUP BY r, template, label, is_base, n_grams, size, run),
kept AS (SELECT *, n_seen::DOUBLE / n_grams AS covered FROM merged WHERE CASE WHEN is_base THEN n_seen = n_grams ELSE n_seen::DOUBLE / n_grams >= {COVERAGE} AND until - first <= {STRETCH} * size END),
named AS (SELECT r, count(*) FILTER (is_base) AS n_base, min(first) FILTER (is_base) AS first_word, max(first) FILTER (is_base) AS last_word,
  coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (is_base)), ','), '') AS base_labels, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(covered) AS score FROM kept GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score FROM docs LEFT JOIN named USING (r)"""
