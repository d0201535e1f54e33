"""SentencePiece encoding and decoding that keeps original byte spans.

Text is normalised by longest-prefix lookups in the model's compiled character
map while every normalised byte records the original byte it came from. The
pieces found in the normalised text are then projected back to spans of the
original UTF-8 bytes.

Defined results: a null or empty text has no pieces, only the begin and end
ids, and decodes to an empty text. Repeated rows and ties give repeated equal
rows; extra input columns are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, split_columns, text_or_empty
from .model_proto import NormalizerSpec, normalizer_spec
from .tokens import Pieces

MARK = "▁".encode()
SPACE = 0x20


class CharMap:
    """Longest-prefix replacement by a compiled double-array trie."""

    def __init__(self, blob: bytes) -> None:
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist() if blob else []
        self.strings = blob[4 + size :]
        self.first = frozenset(b for b in range(256) if self._step(0, b) is not None) if self.units else frozenset()

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def _step(self, node: int, byte: int) -> int | None:
        at = node ^ self._offset(self.units[node]) ^ byte
        return at if at < len(self.units) and self.units[at] & 0x800000FF == byte else None

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes taken, replacement) of the longest key at a position."""
        best, node = None, 0
        for n in range(at, len(data)):
            if (node := self._step(node, data[n])) is None:
                break
            if self.units[node] >> 8 & 1:
                value = self.units[node ^ self._offset(self.units[node])] & 0x7FFFFFFF
                best = n + 1 - at, value
        return None if best is None else (best[0], self.strings[best[1] : self.strings.index(b"\0", best[1])])


class Normalizer:
    def __init__(self, spec: NormalizerSpec) -> None:
        self.spec = spec
        self.map = CharMap(spec.charsmap)
        self.space = MARK if spec.escape_whitespaces else b" "
        self.plain = not spec.charsmap and not spec.remove_extra_whitespaces

    def __call__(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and for each border between them the border in the original."""
        return self._plain(data) if self.plain else self._mapped(data)

    def _plain(self, data: bytes) -> tuple[bytes, np.ndarray]:
        if not data:
            return b"", np.zeros(1, np.int64)
        prefix = self.space if self.spec.add_dummy_prefix else b""
        width = np.where(np.frombuffer(data, np.uint8) == SPACE, len(self.space), 1)
        borders = np.r_[np.zeros(len(prefix), np.int64), np.repeat(np.arange(len(data)), width), len(data)]
        return prefix + data.replace(b" ", self.space), borders

    def _prefix(self, data: bytes, at: int) -> tuple[int, bytes]:
        if data[at] in self.map.first and (found := self.map.longest(data, at)):
            return found
        lead = data[at]
        n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return n, data[at : at + n]

    def _mapped(self, data: bytes) -> tuple[bytes, np.ndarray]:
        spec, at, out, borders = self.spec, 0, bytearray(), []
        if spec.remove_extra_whitespaces:
            while at < len(data) and (step := self._prefix(data, at))[1] == b" ":
                at += step[0]
        if at == len(data):
            return b"", np.zeros(1, np.int64)

        def put(piece: bytes, origin: int) -> None:
            out.extend(piece)
            borders.extend([origin] * len(piece))

        if spec.add_dummy_prefix:
            put(self.space, at)
        after_space = spec.remove_extra_whitespaces
        while at < len(data):
            n, piece = self._prefix(data, at)
            while after_space and piece.startswith(b" "):
                piece = piece[1:]
            if piece:
                for b in piece:
                    put(self.space if b == SPACE else bytes([b]), at)
                after_space = piece.endswith(b" ")
            at += n
            if not spec.remove_extra_whitespaces:
                after_space = False
        if spec.remove_extra_whitespaces:
            while out.endswith(self.space):
                at = borders[-len(self.space)]
                del out[-len(self.space) :], borders[-len(self.space) :]
        return bytes(out), np.array([*borders, at], np.int64)


class Codec:
    """Encoder of one model, for one Python worker."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.normalizer = Normalizer(normalizer_spec(f.read()))
        self.pieces = Pieces(path)
        self.begin, self.end = self.pieces.sp.bos_id(), self.pieces.sp.eos_id()

    def encode(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text its ids, with begin and end ids, and the border in the original behind each piece."""
        normal = [self.normalizer(t) for t in texts]
        out = []
        for (text, borders), ids in zip(normal, self.pieces.ids([n.decode("utf-8", "replace") for n, _ in normal]), strict=True):
            widths = self.pieces.n_bytes[ids]
            if (ids == self.pieces.sp.unk_id()).any():  # an unknown piece has no width of its own
                proto = self.pieces.raw.encode(text.decode(), out_type="immutable_proto")
                widths = np.array([len(p.surface.encode()) for p in proto.pieces], np.int64)
            ends = borders[np.minimum(np.cumsum(widths), len(borders) - 1)]
            out.append((np.r_[[self.begin], ids, [self.end]].astype("<u4"), ends))
        return out

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        return self.pieces.sp.decode([x.tolist() for x in ids], num_threads=1)


#: What encode_documents can return, with the SQL type of each.
OUTPUTS = {
    "n_tokens": "long",
    "ids": "binary",
    "span_ends": "binary",
    "decoded": "string",
    "ids_sha256": "string",
    "decoded_sha256": "string",
    "spans_crc32": "long",
}


def encode_documents(df: DataFrame, model_path: str, outputs: tuple[str, ...] = ("n_tokens", "ids", "span_ends", "decoded"), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode every whole text; one row per input row.

    ids: uint32 with begin and end ids; span_ends: uint32, for each piece between
    them the end of its span in the original UTF-8 bytes (a piece begins where the
    one before it ends); the rest are digests of these.
    """
    unknown = set(outputs) - OUTPUTS.keys()
    if unknown:
        raise ValueError(f"unknown outputs: {sorted(unknown)}")
    bounded_batches(df.sparkSession)
    key_type = df.schema[key].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        codec = Codec(model_path)
        arrow = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
        for batch in batches:
            for keys, texts in split_columns(batch, [key, text]):
                rows = codec.encode(texts)
                need_text = {"decoded", "decoded_sha256"} & set(outputs)
                decoded = codec.decode([ids for ids, _ in rows]) if need_text else [""] * len(rows)
                made = {
                    "n_tokens": lambda ids, ends, s: len(ids),
                    "ids": lambda ids, ends, s: ids.tobytes(),
                    "span_ends": lambda ids, ends, s: ends.astype("<u4").tobytes(),
                    "decoded": lambda ids, ends, s: s,
                    "ids_sha256": lambda ids, ends, s: hashlib.sha256(ids).hexdigest(),
                    "decoded_sha256": lambda ids, ends, s: hashlib.sha256(s.encode()).hexdigest(),
                    "spans_crc32": lambda ids, ends, s: zlib.crc32(ends.astype("<u4")),
                }
                columns = [pa.array([made[o](ids, ends, s) for (ids, ends), s in zip(rows, decoded, strict=True)], arrow[OUTPUTS[o]]) for o in outputs]
                yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(key).type), *columns], names=[key, *outputs])

    schema = ", ".join([f"`{key}` {key_type}", *(f"{o} {OUTPUTS[o]}" for o in outputs)])
    return df.select(F.col(key), text_or_empty(text).alias(text)).mapInArrow(run, schema)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), ("n_tokens", "ids_sha256", "decoded_sha256", "spans_crc32"))
