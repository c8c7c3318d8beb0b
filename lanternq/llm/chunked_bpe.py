"""Byte-level BPE by content-defined chunks.

A rolling hash over the last ``WINDOW`` characters picks chunk ends, so texts
that share a passage share its chunks wherever it stands in them.  A chunk
that a worker has met lately is not encoded again: its ids come from a store
of bounded size.

A chunk may begin and end inside a word, so its first and last ids need not be
those of the whole text.  Inside a chunk, a space between two characters that
are not white space is a sure split: the tokenizer splits there whatever stands
around it.  What lies between a chunk's last sure split and the next chunk's
first one is encoded again as one span, and the result replaces the ids on
both sides; a span without a sure split takes in the next chunk as well, until
both of its ends agree with the ids beside it.

Reuse is within a worker.  Encoding each chunk once in the whole cluster would
move every chunk's hash and the shared chunks' ids through shuffles.

Defined results: a null text counts as empty and has no ids; texts that hold
the string of a special token are encoded by the library as a whole; an empty
table gives an empty result; rows that repeat are each encoded.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import Remembered, byte_characters, packed, resting, slices

WINDOW = 32
#: One of so many places is a chunk end, as a power of two.
MEAN_BITS = 9
SHORTEST, LONGEST = 64, 4096
#: Characters whose hashes are computed at once.
BLOCK = 1 << 18
#: Megabytes of chunks that a worker remembers (twice this at most).
CHUNKS_MB = 24
_BASE, _ODD = 0x01000193, np.uint32(2654435761)
#: Characters that are surely no white space.
SOLID = "!-~¡-ᙿ、-퟿"
SURE = re.compile(f"(?<=[{SOLID}])(?= [{SOLID}])")
PLAIN = re.compile("[\t\n -~À-ÖØ-öø-ſ¡§«°»¿–—‘’“”…€]*")
#: How byte-level BPE splits a text (fixed by the kind of tokenizer file).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoded(NamedTuple):
    """A chunk encoded by itself: text and ids before its first sure split, ids
    from there to its last one, text and ids after that.  A chunk without any
    sure split is all head, and its tail is None."""

    head: str
    head_ids: bytes
    ids: bytes
    tail: str | None
    tail_ids: bytes

    def __sizeof__(self) -> int:
        return 200 + len(self.head) + len(self.ids) + len(self.head_ids)


def _codes(text: str) -> np.ndarray:
    if text.isascii():
        return np.frombuffer(text.encode(), np.uint8)
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def rolling_ends(text: str) -> list[int]:
    """Places after which the hash of the last ``WINDOW`` characters asks for an end."""
    codes, out = _codes(text), []
    for low in range(0, len(codes) - WINDOW + 1, BLOCK):
        h = codes[low : low + BLOCK + WINDOW - 1].astype(np.uint32)
        width, power = 1, _BASE
        while width < WINDOW:  # the hash of twice as many characters from two of half
            h = h[:-width] * np.uint32(power) + h[width:]
            width, power = 2 * width, power * power & 0xFFFFFFFF
        out.append(np.flatnonzero(h * _ODD >> np.uint32(32 - MEAN_BITS) == 0) + low + WINDOW)
    return np.concatenate(out).tolist() if out else []


def chunks(text: str) -> list[str]:
    out, last = [], 0
    for end in [*rolling_ends(text), len(text)]:
        while end - last > LONGEST:
            out.append(text[last : last + LONGEST])
            last += LONGEST
        if end - last >= SHORTEST or end == len(text) > last:
            out.append(text[last:end])
            last = end
    return out


class ChunkedEncoder:
    """Encodes with a tokenizer file.

    Spans of ``PLAIN`` characters, whose kinds all Unicode versions agree on, go
    to an encoder of the same vocabulary that keeps no offsets; all others go
    through the tokenizer itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        of = byte_characters()
        added = self.tokenizer.get_added_tokens_decoder()
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        tokens = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.bytes_of = [t.encode() if i in added else bytes(map(of.__getitem__, t)) for i, t in enumerate(tokens)]
        ranks = {b: i for i, b in enumerate(self.bytes_of) if i not in added}
        self.plain = tiktoken.Encoding("same-vocabulary", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.special = [t.content for t in added.values()]
        self.known = Remembered(self._chunk, CHUNKS_MB)
        #: Chunks met, and encoded; joins between chunks, and those whose ids changed.
        self.met = self.encoded = self.joins = self.repaired = 0

    def span(self, text: str) -> bytes:
        """Ids of a text that is encoded as a whole."""
        if not text:
            return b""
        if PLAIN.fullmatch(text):
            return packed(self.plain.encode_ordinary(text))
        return packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _chunk(self, chunk: str) -> Encoded:
        self.encoded += 1
        first = SURE.search(chunk)
        if first is None:
            return Encoded(chunk, self.span(chunk), b"", None, b"")
        a = b = first.start()
        last = chunk.rfind(" ", a)
        while last > a:
            if SURE.match(chunk, last):
                b = last
                break
            last = chunk.rfind(" ", a, last)
        return Encoded(chunk[:a], self.span(chunk[:a]), self.span(chunk[a:b]), chunk[b:], self.span(chunk[b:]))

    def encode(self, text: str) -> bytes:
        """Little-endian ids of a text."""
        if any(s in text for s in self.special):
            return packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        done: list[bytes] = []
        # Since the last sure split: the text, and the ids that the chunks have for it.
        span: list[str] = []
        own: list[bytes] = []
        for piece in chunks(text):
            self.met += 1
            chunk = self.known[piece]
            if chunk.head:
                span.append(chunk.head)
                own.append(chunk.head_ids)
            if chunk.tail is not None:
                done += (self._joined(span, own), chunk.ids)
                span, own = [chunk.tail], [chunk.tail_ids]
        done.append(self._joined(span, own))
        return b"".join(done)

    def _joined(self, span: list[str], own: list[bytes]) -> bytes:
        """Ids of a span over one or more joins: both of its ends are sure
        splits, so there they agree with the ids beside it."""
        ids = b"".join(own)
        if len(span) < 2:
            return ids
        self.joins += 1
        again = self.span("".join(span))
        self.repaired += again != ids
        return again

    def decode(self, ids: bytes) -> bytes:
        """The bytes that little-endian ids stand for."""
        return b"".join(map(self.bytes_of.__getitem__, memoryview(ids).cast("I")))

@lru_cache(maxsize=1)
def chunked_encoder(path: str) -> ChunkedEncoder:
    return ChunkedEncoder(path)


#: Texts are encoded and passed on in groups of about so many characters.
GROUP_CHARS = 1 << 21


def tokenize(docs: DataFrame, tokenizer_path: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, the ids as
    little-endian bytes) for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = chunked_encoder(tokenizer_path)
        try:
            for batch in batches:
                for part in slices(batch, "text", GROUP_CHARS):
                    yield _tokenized(encoder, part, keep_ids)
        finally:  # a worker lives on for tasks of other stages
            encoder.known.forget()

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(resting(run), schema)


def _tokenized(encoder: ChunkedEncoder, rows: pa.RecordBatch, keep_ids: bool) -> pa.RecordBatch:
    n_tokens, ids_sha, decoded_sha, kept = [], [], [], []
    for text in rows.column("text"):
        ids = encoder.encode(text.as_py() or "")
        decoded = encoder.decode(ids).decode("utf-8", "replace").encode()
        n_tokens.append(len(ids) // 4)
        ids_sha.append(hashlib.sha256(ids).hexdigest())
        decoded_sha.append(hashlib.sha256(decoded).hexdigest())
        if keep_ids:
            kept.append(ids)
    columns = {
        "doc_id": rows.column("doc_id"),
        "n_tokens": pa.array(n_tokens, pa.int64()),
        "ids_sha256": pa.array(ids_sha, pa.string()),
        "decoded_sha256": pa.array(decoded_sha, pa.string()),
    }
    if keep_ids:
        columns["ids"] = pa.array(kept, pa.binary())
    return pa.RecordBatch.from_pydict(columns)
