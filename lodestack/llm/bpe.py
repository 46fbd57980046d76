"""Byte-level BPE encoding and decoding over Arrow batches.

A rank file (token bytes and rank per line) becomes a model of the tokenizers library: bytes are written as printable
characters by a fixed one-to-one table, and the merges follow from the ranks. Texts are cut by the pattern; every distinct
piece that a task has not met yet is encoded by the library, once, and the ids of a text are put together from its pieces.
Pieces are encoded apart from each other, so this is the same as encoding whole texts. Decoding goes from ids to the
tokens' bytes; a character whose bytes lie in several tokens appears once all of them are joined.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.words import slices

#: Distinct pieces that a task remembers; beyond, it forgets all of them and goes on.
MEMORY = 150_000
#: Pieces that are encoded in one call.
AT_ONCE = 4_096


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte: itself where printable, else the next one from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The pair that each longer token comes from: what is left after merging its bytes by all lower ranks."""
    out = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) < 2:
            continue
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = min((ranks.get(parts[i] + parts[i + 1], rank), i) for i in range(len(parts) - 1))
            if best >= rank:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2:
            out.append((parts[0], parts[1]))
    return out


def build_model(path: str) -> str:
    """The tokenizers library's JSON of the rank file's model, small enough to ship with each task."""
    from tokenizers import Tokenizer, models

    ranks, shown = read_ranks(path), byte_characters()

    def write(token: bytes) -> str:
        return "".join(shown[b] for b in token)

    vocab = {write(token): rank for token, rank in ranks.items()}
    merges = [(write(a), write(b)) for a, b in merges_of(ranks)]
    return Tokenizer(models.BPE(vocab=vocab, merges=merges, ignore_merges=True)).to_str()


class Codec:
    """Encodes and decodes with one model; `pattern` cuts texts into the pieces that are encoded apart."""

    def __init__(self, model: str, pattern: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(model)
        self.pattern = regex.compile(pattern)
        self.shown = byte_characters()
        table = [""] * 256
        for byte, character in self.shown.items():
            table[byte] = character
        self.table = table
        back = {character: byte for byte, character in self.shown.items()}
        size = max(self.model.get_vocab().values()) + 1
        self.tokens = [b""] * size
        for token, n in self.model.get_vocab().items():
            self.tokens[n] = bytes(back[c] for c in token)
        self.pieces: dict[str, bytes] = {}

    def write(self, piece: str) -> str:
        # latin-1 reads each byte as one character, which the table then replaces
        return piece.encode().decode("latin-1").translate(self.table)

    def learn(self, pieces: set[str]) -> None:
        new = sorted(pieces - self.pieces.keys())
        if len(self.pieces) + len(new) > MEMORY:
            self.pieces.clear()
            new = sorted(pieces)
        for start in range(0, len(new), AT_ONCE):  # an encoding takes far more memory than its ids
            some = new[start : start + AT_ONCE]
            for piece, found in zip(some, self.model.encode_batch_fast([self.write(p) for p in some], add_special_tokens=False)):
                self.pieces[piece] = np.array(found.ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit numbers."""
        cut = [self.pattern.findall(text) for text in texts]
        self.learn({piece for pieces in cut for piece in pieces})
        known = self.pieces
        return [b"".join([known[piece] for piece in pieces]) for pieces in cut]

    def decode(self, ids: bytes) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[n] for n in np.frombuffer(ids, "<u4").tolist()])

    def offsets(self, text: str) -> list[tuple[int, int]]:
        """(start, end) of each token of a text in characters; a token with part of a character covers the whole of it."""
        lengths = [len(self.tokens[n]) for n in np.frombuffer(self.encode([text])[0], "<u4")]
        ends = np.cumsum(lengths, dtype=np.int64)
        owner = np.repeat(np.arange(len(text)), [len(c.encode()) for c in text])
        return [(int(owner[e - n]), int(owner[e - 1]) + 1) for e, n in zip(ends, lengths)]


@functools.lru_cache(2)
def codec(model: str, pattern: str) -> Codec:
    return Codec(model, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256, and with `keep_ids` the array `ids`.

    A null or empty text has no tokens and the digest of no bytes. The bytes decoded from the ids are those of the text, so
    `decoded_sha256` equals the text's own digest. Rows are handled one by one: repeated rows repeat, an empty table gives no
    rows, other columns are not looked at. The text must be valid UTF-8, as Spark's strings are.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(build_model(path))  # a vocabulary: no larger than its file, times three
    id_type = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shipped.value, pattern)
        for batch in slices(batches, "text", 1 << 20):
            encoded = own.encode([t or "" for t in batch.column(1).to_pylist()])
            columns = [
                batch.column(0),
                pa.array([len(ids) // 4 for ids in encoded], pa.int64()),
                pa.array([hashlib.sha256(ids).hexdigest() for ids in encoded], pa.string()),
                pa.array([hashlib.sha256(own.decode(ids)).hexdigest() for ids in encoded], pa.string()),
            ]
            if keep_ids:
                columns.append(pa.array([np.frombuffer(ids, "<u4").astype(np.int64) for ids in encoded], pa.list_(pa.int64())))
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"doc_id {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<bigint>" * keep_ids
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)
