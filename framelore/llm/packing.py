"""Harmonic packing of tokenised documents into sequences of CAPACITY tokens.

A piece of length s is of class k = CAPACITY // s; a bin of class k takes k pieces, however long. Full bins of different
classes, and of different workers, never depend on each other: a piece's bin is its rank within the class divided by k.

Documents may be cut, so a document gives whole sequences first. What is left stays whole where its class fills a bin to
FILL or more, or where it is of class WHOLE_FROM or beyond; otherwise the length that fills the next class exactly is cut
off and the rest is treated likewise. From WHOLE_FROM on, only classes that grow by the factor COARSE are used, some 90 in
all. The last, incomplete bins of all classes together hold a bounded number of pieces, fewer than the sum of the classes,
about 26,000 for 4096 tokens; these alone are placed by first fit, longest first.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import map_rows, materialise, table

CAPACITY = 4096
FILL = 0.985
WHOLE_FROM = 64
COARSE = 1.2
END_ID = 2
TOKENIZER = "word_bpe_49k.json"
CACHED_CHUNKS = 700_000
SEPARATORS = regex.compile("[\x1c-\x1f]")


def classes(capacity: int = CAPACITY) -> list[int]:
    """The classes in use: 1, 2, ... WHOLE_FROM, then by the factor COARSE up to ``capacity`` pieces of one token."""
    out = list(range(1, min(WHOLE_FROM, capacity) + 1))
    while out[-1] < capacity:
        out.append(min(capacity, int(out[-1] * COARSE) + 1))
    return out


def pieces(length: int, known: list[int]) -> Iterator[tuple[int, int, int]]:
    """(start, length, class) of the pieces that ``length`` tokens are cut into; ``known``: the classes in use."""
    capacity = known[-1]
    start = 0
    while length > 0:
        k = capacity // length
        if length >= capacity:
            size, k = capacity, 1
        elif k >= WHOLE_FROM or length * k >= FILL * capacity:
            size, k = length, known[bisect_right(known, k) - 1]
        else:
            k += 1
            size = capacity // k
        yield start, size, k
        start, length = start + size, length - size


def byte_letters() -> dict[int, str]:
    """The character by which byte-level vocabularies spell each byte: visible ones stand for themselves, others follow U+0100."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(0x100 + i) for i, b in enumerate(hidden)}


class Encoder(dict):
    """Token ids of whole texts by a tokenizer file; as a dictionary, the ids of recent chunks.

    The tokenizer's words never span white space, so a text's ids are those of its chunks between white space, one after
    another. Chunks repeat, so each distinct one is encoded once.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        assert isinstance(self.tokenizer.pre_tokenizer, pre_tokenizers.Sequence)
        self.normal = self.tokenizer.normalizer.normalize_str
        self.tokens = self.tokenizer.model.tokenize
        self.letters = byte_letters()
        self.chunk = regex.compile(r"\S+")
        self.word = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")

    def ids(self, text: str) -> np.ndarray:
        # str.split also splits at the separators U+001C to U+001F, which the tokenizer takes for words.
        chunks = self.chunk.findall(text) if SEPARATORS.search(text) else text.split()
        if len(self) > CACHED_CHUNKS:
            self.clear()
        return np.frombuffer(b"".join(map(self.__getitem__, chunks)), "<u4")

    def __missing__(self, chunk: str) -> bytes:
        if not chunk.isascii():
            found = b"".join([self.word_ids(w) for w in self.word.findall(self.normal(chunk))])
        else:
            plain = chunk.lower()
            words = [plain] if plain.isalpha() else self.word.findall(plain)
            # A word in ASCII is a chunk too: its ids serve with whatever marks surround it.
            found = self.word_ids(plain) if words == [plain] else b"".join([self[w] for w in words])
        self[chunk] = found
        return found

    def word_ids(self, word: str) -> bytes:
        spelt = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.letters)
        tokens = self.tokens(spelt)
        return struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    """One encoder a Python worker, so a worker's next task finds the chunks of its last."""
    return Encoder(path)


def tokenised_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, k."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        encoder, known = _encoder(path), classes(capacity)
        for doc_id, text in rows:
            ids = np.append(encoder.ids(text or ""), np.uint32(end_id)).astype("<u4")
            for start, size, k in pieces(len(ids), known):
                yield doc_id, start, size, zlib.crc32(ids[start : start + size].tobytes()), len(ids), k

    return map_rows(docs, ["doc_id", "text"], "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, k int", run)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with columns length and k, plus sequence_id and offset. Sequence ids run from 0 without gaps.

    A piece's rank in its class comes from the class's counts per slice and its place within the slice, so no class is
    sorted in one task, however many pieces it has.
    """
    spark = pieces.sparkSession
    n_slices = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    key = [F.col(c) for c in ("doc_id", "start", "ids_crc32")]
    dealt = materialise(pieces.withColumn("slice", F.pmod(F.xxhash64(*key), F.lit(n_slices)).cast("int")))
    counts = dealt.groupBy("k", "slice").agg(F.count("*").alias("n"))
    by_class = counts.withColumn("before", F.sum("n").over(W.partitionBy("k").orderBy("slice").rowsBetween(W.unboundedPreceding, -1))).withColumn("all", F.sum("n").over(W.partitionBy("k")))
    # Some 90 classes: their first bins' numbers are a small table.
    bins = counts.groupBy("k").agg(F.expr("floor(sum(n) / k)").alias("bins"))
    first = bins.withColumn("first", F.coalesce(F.sum("bins").over(W.orderBy("k").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("total", F.sum("bins").over(W.orderBy("k").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    small = by_class.join(F.broadcast(first), "k").select("k", "slice", F.coalesce("before", F.lit(0)).alias("before"), "bins", "first", "total")
    ranked = dealt.withColumn("at", F.row_number().over(W.partitionBy("k", "slice").orderBy("doc_id", "start", "ids_crc32")) - 1).join(small, ["k", "slice"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("at")).withColumn("bin", F.floor(F.col("rank") / F.col("k")))
    own = [c for c in pieces.columns if c != "k"]

    full = ranked.where("bin < bins").withColumn("sequence_id", F.col("first") + F.col("bin"))
    inside = W.partitionBy("sequence_id").orderBy("rank")
    full = full.select(*own, "sequence_id", F.coalesce(F.sum("length").over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("offset"))

    # Fewer pieces than the sum of the classes are left, whatever the input, so one task places them.
    rest = ranked.where("bin >= bins").select(*own, "total")

    def place(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True])
        room: list[int] = []
        at: list[tuple[int, int]] = []
        for size in pdf["length"]:
            i = next((i for i, left in enumerate(room) if left >= size), len(room))
            if i == len(room):
                room.append(capacity)
            at.append((i, capacity - room[i]))
            room[i] -= size
        return pdf.assign(sequence_id=pdf["total"] + [i for i, _ in at], offset=[o for _, o in at])[[*own, "sequence_id", "offset"]]

    return full.union(rest.groupBy("total").applyInPandas(place, full.schema))


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents with their sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is the end id alone, a very long one is cut into as many pieces as it takes. Rows that share a doc_id are
    packed one by one, a null doc_id like any other. No rows give no sequences.
    Columns other than doc_id and text are ignored.
    """
    return pack(tokenised_pieces(docs, path, capacity, end_id), capacity)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
