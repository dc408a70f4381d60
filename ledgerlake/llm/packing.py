"""Packing by power-of-two decomposition: every document is cut into pieces whose lengths are powers of two.

A document of n tokens (its ids, then the end id) gives as many full pieces of the context length as fit, then one
piece for each set bit of the rest, the longest first. Pieces of equal length form a bucket, and a batch of a
bucket needs no padding; each piece is a sequence of its own, so no sequence crosses documents and attention
needs no mask. Nothing is shuffled: the pieces follow from a document alone.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, slices, texts

CONTEXT, END = 1024, 0
#: Texts with other characters go to the reference tokenizer itself: letters, marks and signs of Latin script.
PLAIN = re.compile("[\t-\r -ɏ‐-‧€]*")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def bytes_of_symbols() -> dict[str, int]:
    """The usual alphabet of byte-level vocabularies: printable Latin-1 characters stand for themselves, the other
    bytes, in order, for the characters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    odd = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(odd)}


def encoder(vocabulary: str) -> Callable[[str], list[int]]:
    """Text to the ids that the tokenizers library gives for this file, add_special_tokens=False.

    The same byte pairs, merged by rank, are found several times faster by tiktoken; whatever that might split
    otherwise (special tokens' strings, characters outside PLAIN) is encoded by tokenizers.
    """
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(vocabulary)
    spec = json.loads(open(vocabulary, encoding="utf-8").read())
    special = [t["content"] for t in spec.get("added_tokens", [])]
    symbols = bytes_of_symbols()
    ranks = {bytes(symbols[c] for c in w): i for w, i in spec["model"]["vocab"].items() if w not in special}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(text: str) -> list[int]:
        if not PLAIN.fullmatch(text) or any(s in text for s in special):
            return slow.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return ids


def cuts(n: int, context: int = CONTEXT) -> list[int]:
    """Lengths of the pieces of n tokens: full contexts, then the binary digits of the rest, the longest first."""
    rest = n % context
    return [context] * (n // context) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


PIECES = "doc_id long, start long, length long, ids array<int>, doc_tokens long"
DIGEST = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pack(docs: DataFrame, vocabulary: str | None = None, context: int = CONTEXT, digest: bool = False) -> DataFrame:
    """A row per piece: doc_id, start (the document's ids before it), length, ids (or, for a digest, ids_crc32),
    doc_tokens (with the end id), sequence_id, offset (always 0) and bucket (= length).

    A null or empty text is the end id alone. Very long texts give pieces without end, repeated rows give repeated
    pieces in sequences of their own, and null ids stay null. sequence_id is unique but not dense: it holds the
    partition, and the row there. context must be a power of two.
    """
    if context < 1 or context & (context - 1):
        raise ValueError("the context must be a power of two")
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = kept(path, lambda: encoder(path))
        for b in slices(batches):
            out: list[list] = [[], [], [], [], []]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = encode(text)
                ids.append(END)
                raw, at = np.array(ids, "<u4"), 0
                for length in cuts(len(ids), context):
                    part = raw[at : at + length]
                    for column, value in zip(out, (doc, at, length, zlib.crc32(part.tobytes()) if digest else part.astype(np.int32), len(ids)), strict=True):
                        column.append(value)
                    at += length
            names = ["doc_id", "start", "length", "ids_crc32" if digest else "ids", "doc_tokens"]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64() if digest else pa.list_(pa.int32()), pa.int64()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

    pieces = texts(docs).mapInArrow(run, DIGEST if digest else PIECES)
    return pieces.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long")).withColumn("bucket", F.col("length"))
