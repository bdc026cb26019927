"""Packing by power-of-two decomposition.

A document's tokens (ids of a public tokenizer, then an end id) are cut from the left into pieces whose lengths are the
powers of two of its length's binary form, whole ``max_tokens`` first. Each piece is a sequence of its own, so no
sequence crosses documents and none needs padding; ``bucket`` (the exponent) groups pieces of equal length, and
``write_buckets`` stores them by it, so that a batch is made of sequences of one length.

Tokens come from the library's tokenizer, run once for each distinct run of non-white characters that a task
meets (as far as memory of a fixed size holds them): the tokenizer drops ASCII white space and never joins characters across it, so a text's ids are its runs' ids in
a row (tests compare with whole texts). Nothing is shuffled.

Defined results: a null or empty text is the end id alone, one piece of length 1. Repeated rows and null ids are packed
like any other row. Other columns are not read. sequence_id numbers the pieces by partition and place.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .common import small_batches

MAX_TOKENS = 4096
END_ID = 2
VOCABULARY = "word_bpe_49k.json"
KNOWN_BYTES = 32 << 20
MARKS = b".,;:!?*#$%&"
ENTRY_BYTES = 200  # a dictionary entry and the heads of its two objects
LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿĀ-įıĲ-ſ]+")


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet of the vocabulary file as a map of Latin-1 characters: printable bytes stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [c for c in range(256) if c not in plain]
    return {c: chr(c) for c in plain} | {c: chr(256 + k) for k, c in enumerate(other)}


@lru_cache(1)
def tokenizer(path: str) -> Tokenizer:
    """One for each Python worker; its size is fixed."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_file(path)


class RunTokens:
    """Ids (little-endian unsigned 32-bit) of texts by their runs of non-white characters.

    A run that is one word and closing marks is looked up as two parts, since the tokenizer never joins a letter and
    a mark. A word of Latin letters goes to the tokenizer's model at once: lower-casing and the byte alphabet are all that
    its other steps would do. The ids of the first words, marks and other runs met are kept, up to ``KNOWN_BYTES``, later ones for a batch;
    runs of two parts are put together anew, so that each word takes room once. A task makes its own object, so what it keeps goes with it.
    """

    def __init__(self, path: str):
        self.tokenizer = tokenizer(path)
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.known: dict[bytes, bytes] = {}
        self.room = KNOWN_BYTES

    def fits(self, key: bytes, ids: bytes) -> bool:
        """Whether one more entry may be kept; takes its room."""
        self.room -= len(key) + len(ids) + ENTRY_BYTES
        return self.room >= 0

    def part(self, part: bytes, fresh: dict[bytes, bytes]) -> bytes:
        ids = self.known.get(part) or fresh.get(part)
        if ids is None:
            if part.isalpha():  # of bytes: A-Z and a-z only, which stand for themselves
                ids = array("I", [t.id for t in self.model.tokenize(part.lower().decode())]).tobytes()
            elif LATIN.fullmatch(text := part.decode()):
                tokens = self.model.tokenize(text.lower().encode().decode("latin-1").translate(self.letters))
                ids = array("I", [t.id for t in tokens]).tobytes()
            else:
                ids = array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
            (self.known if self.fits(part, ids) else fresh)[part] = ids
        return ids

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        return self.of_bytes([(t or "").encode() for t in texts])

    def of_bytes(self, texts: list[bytes]) -> list[bytes]:
        split = [t.split() for t in texts]
        fresh: dict[bytes, bytes] = {}
        local: dict[bytes, bytes] = {}
        known = self.known
        for run in set().union(*split):
            ids = known.get(run)
            if ids is None:
                word = run.rstrip(MARKS)
                # the last byte of a letter beyond ASCII says nothing: its character does
                if word and len(word) < len(run) and (word[-1:].isalpha() or word[-1] > 127 and word.decode()[-1].lower().isalpha()):
                    ids = self.part(word, fresh) + self.part(run[len(word):], fresh)
                else:
                    ids = self.part(run, fresh)
            local[run] = ids
        return [b"".join(map(local.__getitem__, s)) for s in split]


def pieces(n: int, max_tokens: int = MAX_TOKENS) -> list[int]:
    """Lengths of the pieces of n tokens, longest first."""
    return [max_tokens] * (n // max_tokens) + [1 << k for k in range(max_tokens.bit_length() - 1, -1, -1) if n % max_tokens >> k & 1]


def packed(docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """doc_id, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens, bucket, sequence_id, offset."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    if max_tokens < 1 or max_tokens & (max_tokens - 1):
        raise ValueError("max_tokens must be a power of two")
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("start", T.LongType()),
                           T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("doc_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = RunTokens(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                rows: list[tuple] = []
                for k, ids in enumerate(tokens(part.column(1).to_pylist())):
                    ids += end_id.to_bytes(4, "little")
                    start, total = 0, len(ids) // 4
                    for n in pieces(total, max_tokens):
                        rows.append((k, start, n, ids[4 * start:4 * (start + n)], total))
                        start += n
                at, start, length, raw, total = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(at)), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                     pa.array(raw, pa.binary()), pa.array(total, pa.int64())], names=schema.names)

    small_batches(docs.sparkSession)
    out = docs.select("doc_id", "text").mapInArrow(run, schema)
    return out.select("*", F.round(F.log2("length")).cast("int").alias("bucket"),
                      F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))


def write_buckets(sequences: DataFrame, path: str) -> None:
    """Stores sequences by bucket; each file holds sequences of one length."""
    sequences.write.partitionBy("bucket").parquet(path)
