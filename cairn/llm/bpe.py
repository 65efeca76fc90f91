"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

Every byte of the UTF-8 text is mapped to a printable character, the library merges
these characters, and decoding maps the characters of each id back to bytes. A character
of the text may be split over several tokens: byte offsets are exact, and character
offsets of such tokens cover the whole character that they hold a part of.

Defined cases: a null text is encoded as the empty text (no ids); null document ids are
kept; repeated rows give repeated results; an empty table gives an empty table. Only the
named columns are read, so further columns may have any name. Very long texts are encoded
in pieces that end between a letter and the blank after it, where a match always ends, so
memory does not follow the length of a text's tokens in the library.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Characters handed to the library at once, and the length beyond which a text is cut into pieces.
CALL_CHARS = 400_000
PIECE_CHARS = 100_000

#: Output columns of ``encode`` by name.
OUTPUTS = {
    "n_tokens": (T.LongType(), pa.int64()),
    "ids": (T.ArrayType(T.IntegerType(), False), pa.list_(pa.int32())),
    "byte_starts": (T.ArrayType(T.IntegerType(), False), pa.list_(pa.int32())),
    "char_starts": (T.ArrayType(T.IntegerType(), False), pa.list_(pa.int32())),
    "char_ends": (T.ArrayType(T.IntegerType(), False), pa.list_(pa.int32())),
    "ids_sha256": (T.StringType(), pa.string()),
    "decoded": (T.StringType(), pa.string()),
    "decoded_sha256": (T.StringType(), pa.string()),
}


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself if printable Latin-1, else the next free one from U+0100."""
    shown = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, free = [], 256
    for b in range(256):
        if b in shown:
            out.append(chr(b))
        else:
            out.append(chr(free))
            free += 1
    return out


class ByteBpe:
    """A vocabulary of ranks as a tokenizers model, with the byte table for decoding."""

    def __init__(self, path: str, pattern: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        chars = byte_characters()
        name = lambda token: "".join(map(chars.__getitem__, token))
        vocabulary = {name(t): r for t, r in ranks.items()}
        merges = [tuple(map(name, _halves(t, ranks))) for t, _ in sorted(ranks.items(), key=lambda x: x[1]) if len(t) > 1]
        self.tokenizer = Tokenizer(models.BPE(vocabulary, merges))
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        # The byte table reverses the mapping of each id's characters.
        byte_of = {c: b for b, c in enumerate(chars)}
        self.table = [b""] * (max(ranks.values()) + 1)
        for token, rank in vocabulary.items():
            self.table[rank] = bytes(map(byte_of.__getitem__, token))
        self.lengths = np.array([len(x) for x in self.table], dtype=np.int64)

    def encode_all(self, texts: Sequence[str]) -> Iterator[list[int]]:
        """The ids of each text, in order."""
        held, chars = [], 0
        for text in texts:
            held.append(text)
            chars += len(text)
            if chars >= CALL_CHARS:
                yield from self._call(held)
                held, chars = [], 0
        yield from self._call(held)

    def _call(self, texts: list[str]) -> Iterator[list[int]]:
        parts = [p for t in texts for p in pieces(t)]
        counts = [sum(1 for _ in pieces(t)) if len(t) > PIECE_CHARS else 1 for t in texts]
        if max(counts, default=1) == 1:
            yield from (e.ids for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False))
            return
        at = 0
        for n in counts:
            ids: list[int] = []
            for p in parts[at : at + n]:
                ids += self.tokenizer.encode_batch_fast([p], add_special_tokens=False)[0].ids
            at += n
            yield ids

    def decode(self, ids: Iterable[int]) -> bytes:
        """The bytes that ``ids`` stand for; ids out of the vocabulary raise IndexError."""
        return b"".join(map(self.table.__getitem__, ids))

    def offsets(self, ids: Sequence[int], data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First byte, first character and character after the last of each token.

        A token that holds a part of a split character counts that character as its own.
        """
        ends = np.cumsum(self.lengths[np.asarray(ids, dtype=np.int64)]) if len(ids) else np.zeros(0, np.int64)
        starts = ends - (self.lengths[np.asarray(ids, dtype=np.int64)] if len(ids) else 0)
        raw = np.frombuffer(data, dtype=np.uint8)
        char_of = np.cumsum((raw & 0xC0) != 0x80) - 1
        if not len(ids):
            return starts, starts, ends
        return starts, char_of[starts], char_of[ends - 1] + 1


def _halves(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two parts that the merge which makes ``token`` joins: what the lower ranks leave of it."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], len(ranks)))
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return parts[0], parts[1]


_CUT = re.compile(r"[A-Za-z](?=[ \n])")


def pieces(text: str) -> Iterator[str]:
    """``text`` in pieces of about PIECE_CHARS that tokenize as the whole does."""
    at = 0
    while len(text) - at > PIECE_CHARS:
        m = _CUT.search(text, at + PIECE_CHARS)
        if not m:
            break
        yield text[at : m.end()]
        at = m.end()
    yield text[at:]


@lru_cache(maxsize=4)
def model(path: str, pattern: str) -> ByteBpe:
    """One model for each worker process."""
    return ByteBpe(path, pattern)


def encode(
    docs: DataFrame,
    path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: Sequence[str] = (),
    outputs: Sequence[str] = ("ids", "byte_starts", "char_starts", "char_ends"),
) -> DataFrame:
    """Encode whole texts; one row per row of ``docs`` with ``id_col``, ``keep`` and the named ``outputs`` (see OUTPUTS).

    ``decoded`` and its digest are what ``ByteBpe.decode`` makes of the ids. Rows are
    mapped where they are read: there is no shuffle.
    """
    first = [id_col, *keep]
    clash = {*first} & {*outputs}
    if clash:
        raise ValueError(f"columns {sorted(clash)} are both kept and produced")
    source = docs.select(*first, docs[text_col].alias("__text"))
    schema = T.StructType([*[docs.schema[c] for c in first], *[T.StructField(o, OUTPUTS[o][0]) for o in outputs]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path, pattern)
        for batch in batches:
            for part in _bounded(batch):
                yield _encoded(bpe, part, first, outputs)

    return source.mapInArrow(run, schema)


def _bounded(batch: pa.RecordBatch, rows: int = 1024) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _encoded(bpe: ByteBpe, batch: pa.RecordBatch, first: Sequence[str], outputs: Sequence[str]) -> pa.RecordBatch:
    texts = [t or "" for t in batch.column("__text").to_pylist()]
    out: dict[str, list] = {o: [] for o in outputs}
    decoding = any(o.startswith("decoded") for o in outputs)
    offsets = [o for o in outputs if o in ("byte_starts", "char_starts", "char_ends")]
    for text, ids in zip(texts, bpe.encode_all(texts), strict=True):
        data = bpe.decode(ids) if decoding else b""
        if offsets:
            found = dict(zip(("byte_starts", "char_starts", "char_ends"), bpe.offsets(ids, text.encode()), strict=True))
            for o in offsets:
                out[o].append(found[o].astype(np.int32))
        for o in outputs:
            if o == "n_tokens":
                out[o].append(len(ids))
            elif o == "ids":
                out[o].append(ids)
            elif o == "ids_sha256":
                out[o].append(hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest())
            elif o == "decoded":
                out[o].append(data.decode("utf-8", "replace"))
            elif o == "decoded_sha256":
                out[o].append(hashlib.sha256(data).hexdigest())
    return pa.RecordBatch.from_arrays(
        [*[batch.column(c) for c in first], *[pa.array(out[o], OUTPUTS[o][1]) for o in outputs]], names=[*first, *outputs]
    )


def decode(encoded: DataFrame, path: str, pattern: str, ids_col: str = "ids", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Turn id lists back into bytes (``data``) and text (``text``); null lists give null.

    ``text`` shows U+FFFD for what is not whole UTF-8, as in a list that ends within a split character.
    """
    source = encoded.select(*keep, encoded[ids_col].alias("__ids"))
    schema = T.StructType([*[encoded.schema[c] for c in keep], T.StructField("data", T.BinaryType()), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path, pattern)
        for batch in batches:
            for part in _bounded(batch):
                data = [None if ids is None else bpe.decode(ids) for ids in part.column("__ids").to_pylist()]
                text = [None if d is None else d.decode("utf-8", "replace") for d in data]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(data, pa.binary()), pa.array(text, pa.string())], names=[*keep, "data", "text"])

    return source.mapInArrow(run, schema)
