"""Token ids in seekable zstandard files.

A file is a row of independent zstandard frames and, in a skippable frame at
its end, a seek table: a directory that gives for each frame its compressed
size, its size, a checksum of its content and its documents.  A reader takes
the table from the tail and decompresses only the frames it needs.

Layout of the tail (little-endian): skippable-frame magic 0x184D2A5E, length
of what follows, then for each frame ``<IIIqII`` (compressed size, size,
xxh32 of the ids, first document's number in the file, documents, 0), then
the documents' ``<qI`` (doc_id, number of ids), a null-flag byte each, and the
footer ``<QQQII`` (documents, frames, ids, xxh32 of all this, magic).  The
frames are ordinary zstandard; any decoder skips the tail.

Ids are unsigned 32-bit.  Files hold documents in ascending doc_id order and
file k's ids come before those of file k+1.

Defined results: a null or empty text has the end id alone; rows without
doc_id come first; rows that repeat a doc_id are all written, in the order of
their texts; an empty table gives no documents.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import Remembered, byte_characters, fresh_path, packed, partitions, written
from .storage import AtomicFile, reader

END_ID = 2
FRAME_IDS = 1 << 16
SKIPPABLE = 0x184D2A5E
FOOTER_MAGIC = 0x8F92EAB1
FRAME = struct.Struct("<IIIqII")
FOOTER = struct.Struct("<QQQII")
DOCUMENT = np.dtype([("doc_id", "<i8"), ("ids", "<u4"), ("null", "u1")])
#: Megabytes of pieces, and of words, with their ids that a worker remembers (twice this at most).
PIECES_MB, WORDS_MB = 48, 24
#: A longer word or piece is not remembered.
LONG_WORD = 64
#: Characters that are encoded at once.
BLOCK_CHARS = 1 << 14
#: How the tokenizer file normalises and splits; texts are split here only if it does.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PRE_TOKENIZERS = [
    {"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]
#: Blanks, and letters, digits and signs that normalisation only lower-cases.
PLAIN = re.compile("[\t\n\r -~¡§«°»¿À-ÖØ-öø-įı-ſ–—‘’“”…€]*")
#: ``SPLIT`` for such characters in lower case (letters first: no branch before them begins with one).
PIECES = re.compile(r"[a-zß-öø-ſ]+|[0-9]|'s|'t|'re|'ve|'m|'ll|'d|[^\t\n\r 0-9a-zß-öø-ſ]+")


def blocks(text: str) -> Iterator[str]:
    """A text in parts of ``BLOCK_CHARS`` and what is left of a word."""
    start = 0
    while (end := text.find(" ", start + BLOCK_CHARS)) >= 0:
        yield text[start:end]
        start = end
    yield text[start:]


class WordEncoder:
    """Encodes texts with a tokenizer that drops white space and case.

    ``PLAIN`` texts are split here into the pieces that the tokenizer file
    asks for, and the library's model encodes a piece once; its ids are looked
    up from then on.  The library's own way to a word's pieces costs more than
    its model, and most words that are new have known pieces.

    No token spans white space, so a text is taken in blocks that end there.
    A block that is not plain, or holds the string of a special token, is taken
    word by word, and such words go through the whole of the library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.shown = str.maketrans({chr(b): c for c, b in byte_characters().items()})
        held = json.loads(self.tokenizer.to_str())
        #: Whether texts can be split here.
        self.splits = (
            (held["normalizer"] or {}).get("normalizers") == NORMALIZERS
            and (held["pre_tokenizer"] or {}).get("pretokenizers") == PRE_TOKENIZERS
            and not any(t["normalized"] for t in held["added_tokens"])
        )
        self.pieces = Remembered(self._piece, PIECES_MB, LONG_WORD)
        self.known = Remembered(self._word, WORDS_MB, LONG_WORD)

    def _piece(self, piece: str) -> bytes:
        shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.shown)
        return packed([t.id for t in self.model.tokenize(shown)])

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, PIECES.findall(text.lower())))

    def _word(self, word: str) -> bytes:
        if self._is_plain(word):
            return self._plain(word)
        return packed(self.tokenizer.encode(word, add_special_tokens=False).ids)

    def _is_plain(self, text: str) -> bool:
        return self.splits and PLAIN.fullmatch(text) is not None and not any(s in text for s in self.special)

    def _block(self, text: str) -> bytes:
        if self._is_plain(text):
            return self._plain(text)
        return b"".join(map(self.known.__getitem__, text.replace("\n", " ").split(" ")))

    def encode(self, text: str) -> bytes:
        """Little-endian ids of a text."""
        return b"".join(map(self._block, blocks(text)))


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


class TokenFileWriter:
    def __init__(self, uri: str, level: int = 3):
        self.file = AtomicFile(uri)
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.frames: list[bytes] = []
        self.documents: list[tuple[int | None, int]] = []
        self.pending: list[bytes] = []
        self.pending_ids = self.framed = self.ids = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.documents.append((doc_id, len(ids) // 4))
        self.pending.append(ids)
        self.pending_ids += len(ids) // 4
        self.ids += len(ids) // 4
        if self.pending_ids >= FRAME_IDS:
            self._frame()

    def _frame(self) -> None:
        data = b"".join(self.pending)
        packed = self.zstd.compress(data)
        self.file.write(packed)
        self.frames.append(FRAME.pack(len(packed), len(data), xxhash.xxh32_intdigest(data), self.framed, len(self.pending), 0))
        self.framed, self.pending, self.pending_ids = len(self.documents), [], 0

    def close(self) -> None:
        if self.pending:
            self._frame()
        table = np.zeros(len(self.documents), DOCUMENT)
        table["doc_id"] = [d or 0 for d, _ in self.documents]
        table["null"] = [d is None for d, _ in self.documents]
        table["ids"] = [n for _, n in self.documents]
        body = b"".join(self.frames) + table.tobytes()
        footer = FOOTER.pack(len(self.documents), len(self.frames), self.ids, xxhash.xxh32_intdigest(body), FOOTER_MAGIC)
        self.file.write(struct.pack("<II", SKIPPABLE, len(body) + len(footer)) + body + footer)
        self.file.close()


class TokenFile:
    """Reads documents of one file; only their frames are decompressed."""

    def __init__(self, uri: str):
        self.file = reader(uri)
        size = self.file.size()
        self.file.seek(size - FOOTER.size)
        n_documents, n_frames, self.ids, check, magic = FOOTER.unpack(self.file.read(FOOTER.size))
        if magic != FOOTER_MAGIC:
            raise ValueError(f"{uri} has no seek table")
        length = n_frames * FRAME.size + n_documents * DOCUMENT.itemsize
        self.file.seek(size - FOOTER.size - length)
        body = self.file.read(length)
        if xxhash.xxh32_intdigest(body) != check:
            raise ValueError(f"the seek table of {uri} is damaged")
        self.frames = list(FRAME.iter_unpack(body[: n_frames * FRAME.size]))
        self.places = [0, *accumulate(f[0] for f in self.frames)]
        self.documents = np.frombuffer(body, DOCUMENT, offset=n_frames * FRAME.size)
        self.zstd = zstandard.ZstdDecompressor()

    def frame(self, k: int) -> np.ndarray:
        packed, size, check = self.frames[k][:3]
        self.file.seek(self.places[k])
        data = self.zstd.decompress(self.file.read(packed), max_output_size=size)
        if len(data) != size or xxhash.xxh32_intdigest(data) != check:
            raise ValueError(f"frame {k} is damaged")
        return np.frombuffer(data, "<u4")

    def in_frame(self, k: int) -> Iterator[tuple[int | None, np.ndarray]]:
        """doc_id and ids of each document of frame k."""
        ids, at = self.frame(k), 0
        first, count = self.frames[k][3:5]
        for doc_id, n, null in self.documents[first : first + count].tolist():
            yield None if null else doc_id, ids[at : at + n]
            at += n

    def read(self, doc_ids: set[int | None]) -> Iterator[tuple[int | None, np.ndarray]]:
        """The documents asked for, in the order of the file."""
        for k, (_, _, _, first, count, _) in enumerate(self.frames):
            if any((None if n else d) in doc_ids for d, _, n in self.documents[first : first + count].tolist()):
                yield from ((d, ids) for d, ids in self.in_frame(k) if d in doc_ids)


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """Writes docs in doc_id order; a row (part, uri, documents, ids) a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        uri = f"{folder}/part-{part:06d}.tok.zst"
        encoder, out, end = word_encoder(tokenizer_path), None, np.array([end_id], "<u4").tobytes()
        for batch in batches:
            texts, ids = batch.column("text"), batch.column("doc_id").to_pylist()
            for doc_id, text in zip(ids, texts):
                out = out or TokenFileWriter(uri)
                out.add(doc_id, encoder.encode(text.as_py() or "") + end)
        if out:
            out.close()
            yield pa.RecordBatch.from_pylist([{"part": part, "uri": uri, "documents": len(out.documents), "ids": out.ids}])

    dealt = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    dealt = dealt.repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions(F.asc_nulls_first("doc_id"), "text")
    return dealt.mapInArrow(run, "part long, uri string, documents long, ids long")


def read_token_files(spark: SparkSession, files: list[tuple[str, int]]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document of the files
    (uri, number of ids before the file)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(*(c.to_pylist() for c in batch.columns)):
                held = TokenFile(uri)
                for k in range(len(held.frames)):
                    rows = []
                    for doc_id, ids in held.in_frame(k):
                        rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
                        start += len(ids)
                    columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not files:
        return spark.createDataFrame([], schema)
    # One small row a file.
    table = spark.createDataFrame(files, "uri string, start long").repartition(len(files))
    return table.mapInArrow(run, schema)


def token_file_index(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """Writes docs to token files in the shared folder and reads them back."""
    spark = docs.sparkSession
    manifest = written(write_token_files(docs, fresh_path(spark, "tokens"), tokenizer_path, end_id), "manifest")
    # The driver holds a row for each file, not for each document.
    files = sorted((r.part, r.uri, r.ids) for r in manifest.collect())
    starts = [0, *accumulate(n for _, _, n in files)]
    return read_token_files(spark, [(uri, starts[k]) for k, (_, uri, _) in enumerate(files)])
