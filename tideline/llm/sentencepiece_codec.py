"""Operator 1: SentencePiece encoding that keeps source offsets, and decoding.

The model's compiled character map is read into a prefix table.  Normalising
walks the text by longest matching prefix and records, for every normalised
byte, the source byte it came from; each piece's span in the normalised text is
then projected onto the source.  The merges themselves are the installed
library's.  The model file's path is a parameter; every Python worker reads it
once per task from there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import table, text_batches

MODEL = "piece_bpe_32k.model"
SPACE = "▁".encode()  # the visible space of the piece alphabet


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) pairs of a protocol buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            byte = data[i]
            i += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while i < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = varint() if kind == 2 else (4 if kind == 5 else 8)
            yield key >> 3, data[i:i + size]
            i += size


def character_map(blob: bytes) -> dict[bytes, bytes]:
    """Prefix -> replacement of a compiled character map.

    The blob is a length, a double-array trie of 32-bit units and a pool of
    zero-ended replacements that the trie's values point into.
    """
    if not blob:
        return {}
    size = int.from_bytes(blob[:4], "little")
    units = np.frombuffer(blob[4:4 + size], dtype="<u4").tolist()
    pool = blob[4 + size:]

    def offset(u: int) -> int:
        return (u >> 10) << ((u & (1 << 9)) >> 6)

    rules: dict[bytes, bytes] = {}
    todo = [(b"", offset(units[0]))]
    while todo:
        prefix, base = todo.pop()
        for label in range(1, 256):
            at = base ^ label
            if at >= len(units) or (units[at] & 0x800000FF) != label:
                continue
            key, child = prefix + bytes([label]), at ^ offset(units[at])
            if units[at] >> 8 & 1:
                start = units[child] & 0x7FFFFFFF
                rules[key] = pool[start:pool.index(b"\0", start)]
            todo.append((key, child))
    return rules


@dataclass
class Normalizer:
    """The normalisation that a model file asks for."""

    rules: dict[bytes, bytes] = field(default_factory=dict)
    dummy_prefix: bool = True
    squeeze_spaces: bool = True
    escape_spaces: bool = True

    @classmethod
    def of_model(cls, proto: bytes) -> Normalizer:
        n = cls()
        for number, value in _fields(proto):
            if number == 3:  # the normaliser's part of the model
                for k, v in _fields(value):
                    if k == 2:
                        n.rules = character_map(v)
                    elif k == 3:
                        n.dummy_prefix = bool(v)
                    elif k == 4:
                        n.squeeze_spaces = bool(v)
                    elif k == 5:
                        n.escape_spaces = bool(v)
        n.longest = max(map(len, n.rules), default=0)
        return n

    longest: int = 0

    def normalize(self, text: str) -> tuple[bytes, np.ndarray]:
        """Normalised bytes and, for each of them and the end, its source byte."""
        data = text.encode("utf-8", "surrogatepass")
        if not data:
            return b"", np.zeros(1, dtype=np.int64)
        if not self.rules and not self.squeeze_spaces and self.escape_spaces:
            return self._escape_only(data)
        return self._by_prefix(data)

    def _escape_only(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """Identity map: only spaces change, so alignment is one array expression."""
        b = np.frombuffer(data, dtype=np.uint8)
        start = np.flatnonzero((b & 0xC0) != 0x80)          # first byte of every character
        size = np.diff(np.append(start, len(b)))
        size = np.where(b[start] == 0x20, len(SPACE), size)  # in normalised bytes
        source = np.repeat(start, size)
        out = data.replace(b" ", SPACE)
        if self.dummy_prefix:
            out, source = SPACE + out, np.concatenate([np.zeros(len(SPACE), dtype=np.int64), source])
        return out, np.append(source, len(b))

    def _chunk(self, data: bytes, i: int) -> tuple[bytes, int]:
        """Replacement and length of the longest known prefix at ``i``, else one character."""
        for size in range(min(self.longest, len(data) - i), 0, -1):
            out = self.rules.get(data[i:i + size])
            if out is not None:
                return out, size
        lead = data[i]
        size = 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return data[i:i + size], size

    def _by_prefix(self, data: bytes) -> tuple[bytes, np.ndarray]:
        space = SPACE if self.escape_spaces else b" "
        out, source, i = bytearray(), [], 0
        if self.squeeze_spaces:
            while i < len(data):
                got, size = self._chunk(data, i)
                if got != b" ":
                    break
                i += size
        if i == len(data):
            return b"", np.zeros(1, dtype=np.int64)
        if self.dummy_prefix:
            out += space
            source += [i] * len(space)
        after_space = self.squeeze_spaces
        while i < len(data):
            got, size = self._chunk(data, i)
            if after_space:
                got = got.lstrip(b" ")
            if got:
                shown = got.replace(b" ", space)
                out += shown
                source += [i] * len(shown)
                after_space = self.squeeze_spaces and got.endswith(b" ")
            i += size
            if not self.squeeze_spaces:
                after_space = False
        end = len(data)
        if self.squeeze_spaces:
            while out.endswith(space):
                end = source[len(out) - len(space)]
                del out[-len(space):], source[len(out):]
        return bytes(out), np.array([*source, end], dtype=np.int64)


class Codec:
    """One loaded model: ids, source spans and decoding of whole texts."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.normalizer = Normalizer.of_model(self.library.serialized_model_proto())
        n = self.library.get_piece_size()
        self.size = np.array([1 if self.library.is_byte(i) else len(self.library.id_to_piece(i).encode())
                              for i in range(n)], dtype=np.int64)
        self.byte_fallback = any(self.library.is_byte(i) for i in range(n))

    def encode(self, text: str | None) -> list[int]:
        return self.library.encode(text, num_threads=1) if text else []

    def spans(self, text: str | None, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Source byte spans [begin, end) of the pieces ``ids`` of ``text``.

        Pieces of a character that fell back to bytes all start at it; only the
        last one reaches its end.
        """
        normal, source = self.normalizer.normalize(text or "")
        if self.byte_fallback:
            sizes = self.size[ids] if len(ids) else np.zeros(0, dtype=np.int64)
        else:  # an unknown piece is as long as its surface
            sizes = np.array([len(p.encode()) for p in self.library.encode(text or "", out_type=str)], dtype=np.int64)
        ends = np.cumsum(sizes)
        if (int(ends[-1]) if len(ends) else 0) != len(normal):
            raise ValueError("the pieces do not add up to the normalised text")
        return source[ends - sizes], source[ends]

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


_codecs: dict[bytes, Codec] = {}


def codec(model: bytes) -> Codec:
    """The codec of a model's bytes, loaded once a process."""
    name = hashlib.sha256(model).digest()
    if name not in _codecs:
        _codecs[name] = Codec(model)
    return _codecs[name]


def model_bytes(model_file: str) -> bytes:
    """The model file, read on the driver: it travels with the tasks, so executors need no such file."""
    with open(model_file, "rb") as f:
        return f.read()


def encoded(text: Column, model_file: str) -> Column:
    """Struct of ``ids`` with the source byte spans ``begins`` and ``ends`` (null: empty arrays)."""

    model = model_bytes(model_file)

    @F.pandas_udf("ids array<int>, begins array<int>, ends array<int>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = codec(model)
        for t in texts:
            ids = [c.encode(x) for x in t]
            spans = [c.spans(x, i) for x, i in zip(t, ids, strict=True)]
            yield pd.DataFrame({"ids": [np.array(i, dtype=np.int32) for i in ids],
                                "begins": [b.astype(np.int32) for b, _ in spans],
                                "ends": [e.astype(np.int32) for _, e in spans]})

    return run.asNondeterministic()(text.cast("string"))


def decoded(ids: Column, model_file: str) -> Column:
    """Text of an id array (null: empty text)."""

    model = model_bytes(model_file)

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec(model)
        for p in parts:
            yield pd.Series([c.decode([int(i) for i in ids]) if ids is not None else "" for ids in p], dtype=object)

    return run.asNondeterministic()(ids)


def encode_documents(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, ids, begins and ends of every whole text; null and empty texts give empty arrays."""
    text_batches(docs.sparkSession, 200)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), encoded(F.col("text"), model_file).alias("e"))
    return rows.select("doc_id", "e.*")


def digest_documents(docs: DataFrame, model_file: str) -> DataFrame:
    """Encode, check the spans and decode in one pass; only digests leave the Python worker.

    A null or empty text has no tokens.  Null and repeated ids keep their rows,
    repeated rows give equal results, other columns are ignored, and an empty
    table gives an empty result.

    ``source_bytes`` is the number of source bytes that the projected spans
    cover, equal to the text's size for a model that drops nothing.
    """
    text_batches(docs.sparkSession, 200)
    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string, source_bytes long"
    model = model_bytes(model_file)

    @F.pandas_udf(schema)
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = codec(model)
        for t in texts:
            out = []
            for x in t:
                ids = c.encode(x)
                begins, ends = c.spans(x, ids)
                out.append((len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                            hashlib.sha256(c.decode(ids).encode("utf-8", "surrogatepass")).hexdigest(),
                            int((ends - begins).sum())))
            yield pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256", "source_bytes"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       run.asNondeterministic()(F.col("text").cast("string")).alias("d"))
    return rows.select("doc_id", "d.*")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(MODEL))
