"""Byte-level BPE encoding and decoding with a public vocabulary file.

A pretoken's symbols form a doubly linked list; a priority queue holds the
merge rank of each adjacent pair.  The lowest rank is popped, entries whose
symbols have changed since are skipped, and a merge enters the new pairs on
both sides.  Decoding concatenates the vocabulary's byte strings.

Encoding is one narrow Arrow pass.  The vocabulary (fixed size) is read once on
the driver from a path that is a parameter, and broadcast.  A worker remembers
the ids of at most twice ``CACHE`` pretokens; that changes speed, never results.

Defined cases: null is encoded like the empty text, which has no tokens; the
vocabulary's special strings become their own ids, as in the file's library;
of equal ranks the leftmost pair merges first; ids, null or repeated, pass
through untouched; repeated rows give equal results; a very long text is a batch
of its own, split into pretokens at once, and one pretoken of n bytes costs about
n log n; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import table, text_batches

CACHE = 250_000
#: Longer pretokens are encoded each time, so that the cache's bytes are bounded.
CACHED_CHARS = 64
# Fixed value: the public split pattern of byte-level BPE.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(1)
def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: visible Latin-1 for itself, the rest from U+0100 on."""
    visible = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Bpe:
    """A vocabulary: byte strings by id, merge ranks by pair of ids, and special strings."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        names = spec["model"]["vocab"]
        special = {x["content"]: x["id"] for x in spec.get("added_tokens", ())}
        self.special = special
        self.strings = [b""] * (max([*names.values(), *special.values()]) + 1)
        for name, number in names.items():
            self.strings[number] = bytes(letters[c] for c in name)
        for name, number in special.items():
            self.strings[number] = name.encode()
        self.first = [0] * 256
        for letter, byte in letters.items():
            self.first[byte] = names[letter]
        #: Rank of each pair, the pair packed into one number; and by rank: the packed pair and what it becomes.
        self.ranks, self.made = {}, []
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            packed = names[left] << 32 | names[right]
            self.ranks[packed] = rank
            self.made.append((packed, names[left + right]))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k in ("special", "strings", "first", "ranks", "made")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)

    def merge(self, data: bytes) -> list[int]:
        """Ids of one pretoken."""
        ids = list(map(self.first.__getitem__, data))
        n = len(ids)
        if n < 2:
            return ids
        rank_of, made, push, pop = self.ranks.get, self.made, heapq.heappush, heapq.heappop
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        # An entry is a rank and a position in one number; the rank says which two symbols it was made for.
        ranked = map(rank_of, [a << 32 | b for a, b in zip(ids, ids[1:], strict=False)])
        queue = [rank << 32 | at for at, rank in enumerate(ranked) if rank is not None]
        heapq.heapify(queue)
        while queue:
            entry = pop(queue)
            at = entry & 0xFFFFFFFF
            other = after[at]
            packed, merged = made[entry >> 32]
            if other < 0 or ids[at] < 0 or ids[at] << 32 | ids[other] != packed:
                continue  # stale: one of its symbols has gone into another merge
            ids[at], ids[other] = merged, -1
            nxt = after[at] = after[other]
            if nxt >= 0:
                before[nxt] = at
                rank = rank_of(merged << 32 | ids[nxt])
                if rank is not None:
                    push(queue, rank << 32 | at)
            prev = before[at]
            if prev >= 0:
                rank = rank_of(ids[prev] << 32 | merged)
                if rank is not None:
                    push(queue, rank << 32 | prev)
        return [x for x in ids if x >= 0]

    def encoder(self):
        """A function from a text to its ids, with a bounded cache of its own."""
        split = regex.compile(SPLIT).findall
        marks = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        fresh: dict[str, list[int]] = {}
        aged: dict[str, list[int]] = {}

        def encode(text: str) -> list[int]:
            nonlocal fresh, aged
            ids: list[int] = []
            parts = marks.split(text) if marks and any(x in text for x in self.special) else [text]
            for part in parts:
                if part in self.special:
                    ids.append(self.special[part])
                    continue
                for piece in split(part):
                    known = fresh.get(piece)
                    if known is None:
                        known = aged.get(piece)
                        if known is None:
                            known = self.merge(piece.encode("utf-8", "surrogatepass"))
                        if len(piece) <= CACHED_CHARS:
                            if len(fresh) >= CACHE:
                                aged, fresh = fresh, {}
                            fresh[piece] = known
                    ids += known
            return ids

        return encode

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


def tokenize(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", outputs: tuple[str, ...] = ("n_tokens", "ids_sha256", "decoded_sha256")) -> DataFrame:
    """doc_id and the named outputs for each row: ids (array), decoded (text), n_tokens, ids_sha256, decoded_sha256."""
    shared = docs.sparkSession.sparkContext.broadcast(Bpe(vocabulary))
    kinds = {"ids": T.ArrayType(T.IntegerType()), "decoded": T.StringType(), "n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}
    arrow = {"ids": pa.list_(pa.int32()), "decoded": pa.string(), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
    schema = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(x, kinds[x]) for x in outputs)])

    def batches(found_batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        encode = model.encoder()
        digits = [str(k) for k in range(len(model.strings))]
        for batch in found_batches:
            found: dict[str, list] = {x: [] for x in outputs}
            for text in batch.column("text").to_pylist():
                ids = encode(text or "")
                if "ids" in found:
                    found["ids"].append(ids)
                if "n_tokens" in found:
                    found["n_tokens"].append(len(ids))
                if "ids_sha256" in found:
                    found["ids_sha256"].append(hashlib.sha256(",".join(map(digits.__getitem__, ids)).encode()).hexdigest())
                if "decoded" in found or "decoded_sha256" in found:
                    back = model.decode(ids)
                    if "decoded" in found:
                        found["decoded"].append(back)
                    if "decoded_sha256" in found:
                        found["decoded_sha256"].append(hashlib.sha256(back.encode()).hexdigest())
            columns = [pa.array(found[x], arrow[x]) for x in outputs]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", *outputs])

    return text_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(batches, schema)


def public_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize(table(spark, sf_dir, "documents"), public_vocabulary())


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: each document's token ids, with their count and the digest of their decoded text."""
    return tokenize(docs, public_vocabulary(), outputs=("n_tokens", "ids", "decoded_sha256"))
