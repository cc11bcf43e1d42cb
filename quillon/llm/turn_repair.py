"""Repair of conversation structure: the cheapest edits that make roles alternate.

Rows of a conversation, in order of turn, shall give role initials that match
``(s?(ua)+)?``.  Keep costs 0, Rerole to user or assistant 1, Delete 2, Insert of
an empty turn 5; a blank row or a repeated one must go, a truncated row that
stays costs 5 more.  Of equally cheap edits the ASCII-least audit (their initials
in order) wins.

The grammar has four states: nothing yet, s, u and a.  What a row can do is a
small table from state to state, each entry the least cost with its audit; such
tables compose, so a conversation is cut into segments of neighbouring rows:

1. faults come from column functions and aggregates over digests of texts;
2. rows are numbered over all conversations by a sort of ranges, and runs of
   SEGMENT numbers of one conversation are a segment, so a conversation with a
   third of all rows is spread like any other;
3. segments are dealt by hash.  A batch of them meets one recursive DuckDB query,
   each recursion of which advances one turn in all conversations of the batch,
   keeping the least cost and audit of each pair of first and present state;
4. segments of one conversation compose by the same query, FAN at a time, until
   one is left.

The digest of the repaired text is serial by its definition: a conversation's
rows stream in order through one task, which holds its audit and one batch.

Defined cases: a null role or text counts as one space, a null conv_id or turn as
one space in the hash that damages; null turns come first and null conv_ids are
one conversation; rows of one turn go by role, then by the MD5 of role and text;
equal rows are repetitions of the first; roles other than s..., u..., a... can
only be reroled or deleted, an empty role has no initial; empty tables give
empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import cut, numbered, scratch, table, text_batches

#: Rows of a segment, segments that compose in one step, and rows that share a query, at least.
SEGMENT, FAN, QUERY_ROWS = 256, 64, 20_000
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: States of the grammar: nothing yet, and the last initial.
START, S, U, A = range(4)
#: The one initial other than s that may follow a state.
NEXT = {START: U, S: U, U: A, A: U}
INITIALS = {"s": S, "u": U, "a": A}
NAMES = {U: "user", A: "assistant"}
#: Faults of a row in order of precedence.
SOUND, BLANK, DUPLICATE, CUT_OFF = range(4)
#: At most two inserts in a row are of use: three lead where one does.
INSERTS = 2


def _moves() -> list[tuple[str, int, int, int, int, str]]:
    """(initial, fault, from, to, cost, audit): the cheapest ways past one row, inserts before it included."""
    best: dict[tuple, tuple[int, str]] = {}
    for initial in ("s", "u", "a", "x"):
        for fault in (SOUND, BLANK, DUPLICATE, CUT_OFF):
            for begin in (START, S, U, A):
                state, extra = begin, CUT_OFF == fault and TRUNCATED or 0
                for n in range(INSERTS + 1):
                    ways = [(state, DELETE, "D")]
                    if fault in (SOUND, CUT_OFF):
                        ways.append((NEXT[state], REROLE + extra, "R"))
                        own = INITIALS.get(initial)
                        if own == NEXT[state] or (own == S and state == START):
                            ways.append((own, KEEP + extra, "K"))
                    for to, cost, letter in ways:
                        found = (cost + INSERT * n, "I" * n + letter)
                        key = (initial, fault, begin, to)
                        best[key] = min(best.get(key, found), found)
                    state = NEXT[state]
    return [(*key, *value) for key, value in sorted(best.items())]


MOVES = pa.Table.from_pylist([dict(zip(("initial", "fault", "f", "t", "cost", "audit"), row, strict=True)) for row in _moves()])

#: Over parts (g, k, f, t, cost, audit), the ways from f to t past the k-th part of group g: the best past all parts.
RECURSION = """
WITH RECURSIVE sizes AS (SELECT g, max(k) + 1 AS n FROM parts GROUP BY g),
dp AS (
    SELECT g, n, 0::BIGINT AS k, f, f AS t, 0::BIGINT AS cost, '' AS audit FROM sizes, (SELECT unnest(range(4)) AS f)
  UNION ALL
    SELECT g, n, k + 1, f, t, best.cost, best.audit
    FROM (
        SELECT dp.g, dp.n, dp.k, dp.f, parts.t, min({'cost': dp.cost + parts.cost, 'audit': dp.audit || parts.audit}) AS best
        FROM dp JOIN parts ON parts.g = dp.g AND parts.k = dp.k AND parts.f = dp.t
        GROUP BY dp.g, dp.n, dp.k, dp.f, parts.t
    )
)
SELECT g, f, t, cost, audit FROM dp WHERE k = n
UNION ALL
SELECT g, -1, -1, sum(inner_breaks + (last || following NOT IN ('su', 'ua', 'au') AND following IS NOT NULL)::BIGINT),
    arg_min(first, k) || arg_max(last, k)
FROM (SELECT g, k, inner_breaks, first, last, lead(first) OVER (PARTITION BY g ORDER BY k) AS following FROM edges)
GROUP BY g
"""
PLACE = "dense_rank() OVER (PARTITION BY none, conv, seg ORDER BY below) - 1"
OUT = "none boolean, conv string, seg long, f int, t int, cost long, audit string"


def words_end(text: Column) -> Column:
    """The last character other than ASCII white space; empty if there is none."""
    return F.substring(F.btrim(text, F.lit(" \t\n\x0b\x0c\r")), -1, 1)


def described(rows: DataFrame) -> DataFrame:
    """(none, conv, turn, role, text, digest, initial, n): rows with n copies each, nulls as spaces, the conversation as a string."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    first = F.substring(role, 1, 1)
    return rows.select(
        F.isnull("conv_id").alias("none"),
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        role.alias("role"),
        text.alias("text"),
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("digest"),
        F.when(first.isin(*INITIALS), first).otherwise("x").alias("initial"),
        F.col("n") if "n" in rows.columns else F.lit(1).alias("n"),
    )


def faults(rows: DataFrame) -> DataFrame:
    """(none, conv, turn, role, digest, initial, fault) for each row and copy of described(); texts stay behind."""
    last = words_end(F.col("text"))
    own = F.when(last == "", BLANK).when(~last.isin(".", "!", "?"), CUT_OFF).otherwise(SOUND)
    same = cut(rows.groupBy("none", "conv", "turn", "role", "digest", "initial", own.alias("own")).agg(F.sum("n").alias("n")))
    # The first turn of a text, null before all others, is found before rows are joined with it, so that Spark can split a hot text's join.
    key = ["none", "conv", "digest"]
    firsts = cut(same.groupBy(*key).agg(F.max(F.isnull("turn")).alias("unnumbered"), F.min("turn").alias("low"), F.count("*").alias("turns")))
    again = firsts.where("turns > 1").select(*key, F.when(~F.col("unnumbered"), F.col("low")).alias("first"), F.lit(True).alias("repeated"))
    joined = same.join(again, key, "left")
    later = F.col("repeated").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first"))
    copy = F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy")
    fault = F.when(F.col("own") == BLANK, BLANK).when(later | (F.col("copy") > 1), DUPLICATE).otherwise(F.col("own"))
    return joined.select("*", later.alias("later"), copy).withColumn("fault", fault).select("none", "conv", "turn", "role", "digest", "initial", "fault")


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[pa.Table]:
    """Whole groups of equal keys, in order, of at least so many rows together but for the last."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count >= rows:
            found = pa.Table.from_batches(held)
            last = [found.column(k)[-1].as_py() for k in keys]
            at = found.num_rows - 1
            while at and [found.column(k)[at - 1].as_py() for k in keys] == last:
                at -= 1
            if at:
                yield found.slice(0, at)
                held, count = found.slice(at).to_batches(), found.num_rows - at
    if count:
        yield pa.Table.from_batches(held)


def _recurse(parts: str, edges: str) -> object:
    """An Arrow pass: whole groups of (none, conv, seg) become DuckDB tables parts and edges by the statements given, and then the best ways past them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = duckdb.connect(config={"threads": 1})
        con.register("moves", MOVES)
        for rows in _groups(batches, ["none", "conv", "seg"], QUERY_ROWS):
            con.register("rows", rows)
            con.execute(f"CREATE OR REPLACE TEMP TABLE given AS SELECT *, dense_rank() OVER (ORDER BY none, conv, seg) AS g, {PLACE} AS k FROM rows")
            con.execute(f"CREATE OR REPLACE TEMP TABLE parts AS {parts}")
            con.execute(f"CREATE OR REPLACE TEMP TABLE edges AS {edges}")
            found = con.sql(f"SELECT none, conv, seg, f::INT AS f, t::INT AS t, cost::BIGINT AS cost, audit FROM ({RECURSION}) JOIN (SELECT DISTINCT g, none, conv, seg FROM given) USING (g)")
            yield from found.to_arrow_table().to_batches()
        con.close()

    return run


def ways(rows: DataFrame) -> DataFrame:
    """(none, conv, f, t, cost, audit): for each conversation of rows (none, conv, at, initial, fault), the best ways from grammar state f to t past all its rows;
    f = t = -1 holds the number of illegal neighbours."""
    by = ["none", "conv", "seg"]
    dealt = rows.select("none", "conv", F.expr(f"at div {SEGMENT}").alias("seg"), F.col("at").alias("below"), "initial", "fault").repartition(*by).sortWithinPartitions(*by, "below")
    single = _recurse(
        "SELECT g, k, f, t, cost, audit FROM given JOIN moves USING (initial, fault)",
        "SELECT g, k, 0 AS inner_breaks, initial AS first, initial AS last FROM given",
    )
    several = _recurse(
        "SELECT g, k, f, t, cost, audit FROM given WHERE f >= 0",
        "SELECT g, k, cost AS inner_breaks, audit[1] AS first, audit[-1] AS last FROM given WHERE f < 0",
    )
    parts = cut(text_batches(dealt).mapInArrow(single, OUT))
    done = None
    while True:
        sizes = cut(parts.groupBy("none", "conv").agg(F.min("seg").alias("low"), F.max("seg").alias("high")))
        open_ = sizes.where("low < high").select("none", "conv")
        whole_ = parts.join(open_, ["none", "conv"], "left_anti")
        done = whole_ if done is None else done.union(whole_)
        if open_.isEmpty():
            return done.drop("seg")
        more = parts.join(open_, ["none", "conv"]).withColumnRenamed("seg", "below").withColumn("seg", F.expr(f"below div {FAN}"))
        more = more.repartition(*by).sortWithinPartitions(*by, "below")
        parts = cut(text_batches(more).mapInArrow(several, OUT))


def cheapest(found: DataFrame) -> DataFrame:
    """(none, conv, cost, audit, illegal) from ways(): from nothing yet to an accepted end, with inserts after the last row where needed."""
    extra = F.when(F.col("t") == U, 1).when(F.col("t") == S, 2).otherwise(0)
    best = F.struct((F.col("cost") + INSERT * extra).alias("cost"), F.concat("audit", F.repeat(F.lit("I"), extra)).alias("audit"))
    sums = found.groupBy("none", "conv").agg(F.min(F.when(F.col("f") == START, best)).alias("best"), F.max(F.when(F.col("f") < 0, F.col("cost"))).alias("illegal"))
    return sums.select("none", "conv", "best.cost", "best.audit", "illegal")


def edited(roles: list[str], texts: list[str], copies: list[int], audit: str, at: int, state: int, end: bool) -> tuple[list[tuple[str, str]], int, int]:
    """The (role, text) that the audit from letter at leaves of the next rows, and the letter and grammar state reached."""
    out = []

    def put(role: str, text: str) -> None:
        nonlocal state
        out.append((role, text))
        state = INITIALS[role[0]]

    for role, text, n in zip(roles, texts, copies, strict=True):
        for _ in range(n):
            while audit[at] == "I":
                put(NAMES[NEXT[state]], "")
                at += 1
            if audit[at] == "K":
                put(role, text)
            elif audit[at] == "R":
                put(NAMES[NEXT[state]], text)
            at += 1
    while end and at < len(audit):
        put(NAMES[NEXT[state]], "")
        at += 1
    return out, at, state


def _streamed(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """Rows of described() after their conversation's audit, each conversation in order in one partition."""
    heads = audits.select("none", "conv", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), "audit", F.lit(None).cast("binary").alias("digest"), F.lit(0).alias("n"))
    body = rows.select("none", "conv", F.lit(1).alias("kind"), "turn", "role", F.col("text").alias("audit"), "digest", "n")
    ends = audits.select("none", "conv", F.lit(2).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("audit"), F.lit(None).cast("binary").alias("digest"), F.lit(0).alias("n"))
    by = ["none", "conv"]
    return text_batches(heads.union(body).union(ends).repartition(*by).sortWithinPartitions(*by, "kind", "turn", "role", "digest"))


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple[str, str]], bool]]:
    """(conversation, next repaired turns, whether they are its last) along the rows of _streamed()."""
    audit, at, state = "", 0, START
    for batch in batches:
        none, conv, kind, role, text, n = (batch.column(c).to_pylist() for c in ("none", "conv", "kind", "role", "audit", "n"))
        low = 0
        while low < len(kind):
            if kind[low] == 0:
                audit, at, state = text[low], 0, START
                low += 1
                continue
            high = low
            while high < len(kind) and kind[high] == 1:
                high += 1
            end = high < len(kind) and kind[high] == 2
            key = (none[min(high, len(kind) - 1)], conv[min(high, len(kind) - 1)])
            found, at, state = edited(role[low:high], text[low:high], n[low:high], audit, at, state, end)
            yield key, found, end
            low = high + end


def repaired_turns(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv_id string, place, role, text): the repaired conversations themselves."""

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = 0
        for (none, conv), found, end in _walk(batches):
            n = len(found)
            columns = [[None if none else conv] * n, range(place, place + n), [r for r, _ in found], [t for _, t in found]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["conv_id", "place", "role", "text"])
            place = 0 if end else place + n

    return _streamed(rows, audits).mapInArrow(turns, "conv_id string, place long, role string, text string")


def digests(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """(none, conv, repaired_sha256): of the repaired turns as role:text, joined by newlines."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, joint, done = hashlib.sha256(), b"", []
        for key, found, end in _walk(batches):
            for role, text in found:
                digest.update(joint + f"{role}:{text}".encode("utf-8", "surrogatepass"))
                joint = b"\n"
            if end:
                done.append((*key, digest.hexdigest()))
                digest, joint = hashlib.sha256(), b""
            if len(done) >= 10_000:
                yield batch_of(done)
                done = []
        yield batch_of(done)

    def batch_of(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], t) for k, t in enumerate((pa.bool_(), pa.string(), pa.string()))], names=["none", "conv", "repaired_sha256"])

    return _streamed(rows, audits).mapInArrow(hashed, "none boolean, conv string, repaired_sha256 string")


def audits_of(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For rows of described(): (none, conv, cost, audit, illegal), and (none, conv, gaps, blank, duplicate, truncated)."""
    flawed = faults(rows)
    placed, _ = numbered(flawed, ["none", "conv", F.asc_nulls_first("turn"), "role", "digest"])
    count = [F.sum((F.col("fault") == k).cast("long")).alias(c) for k, c in ((BLANK, "blank"), (DUPLICATE, "duplicate"), (CUT_OFF, "truncated"))]
    turns = placed.groupBy("none", "conv", "turn").agg(*count)
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0))
    counts = turns.groupBy("none", "conv").agg(gaps.alias("gaps"), *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")))
    return cut(cheapest(ways(placed))), counts


def repair(conversations: DataFrame) -> DataFrame:
    """(conv_id string, place, role, text): conversations as their cheapest edits leave them."""
    with scratch(conversations.sparkSession) as outlive:
        rows = described(conversations)
        return outlive(repaired_turns(rows, audits_of(rows)[0]))


def damage(conversations: DataFrame) -> DataFrame:
    """conversations with faults put in by the CRC-32 of conv_id:turn modulo 20; n is the number of copies of a row."""
    part = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(part[0], F.lit(":"), part[1]).cast("binary")) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).where("kind != 0").select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("kind") == 3, 2).otherwise(1).alias("n"),
    )


def report(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """A row for each conv_id of conversations about its rows (conv_id, turn, role, text, n), of which there may be none."""
    with scratch(conversations.sparkSession) as outlive:
        told = described(rows)
        audits, counts = audits_of(told)
        by, zero = ["none", "conv"], F.lit(0).cast("long")
        ids = conversations.select(F.col("conv_id"), F.isnull("conv_id").alias("none"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv")).distinct()
        found = ids.join(counts, by, "left").join(audits, by, "left").join(digests(told, audits), by, "left")
        numbers = [F.coalesce(F.col(c), zero).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
        nothing = F.lit(hashlib.sha256(b"").hexdigest())
        return outlive(found.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256")))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return report(conversations, damage(conversations))
