"""Just enough of the protobuf wire format to read a SentencePiece model file.

Field numbers are those of the public ``sentencepiece_model.proto``.
"""

from __future__ import annotations

from dataclasses import dataclass

# Field numbers of ModelProto and NormalizerSpec, and wire types.
MODEL_NORMALIZER = 3
MODEL_DENORMALIZER = 5
SPEC_CHARSMAP = 2
SPEC_DUMMY_PREFIX = 3
SPEC_REMOVE_EXTRA = 4
SPEC_ESCAPE = 5
VARINT, FIXED64, BYTES, FIXED32 = 0, 1, 2, 5


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 0x7F) << shift
        if b < 0x80:
            return value, at
        shift += 7


def _put(value: int) -> bytes:
    out = bytearray()
    while value >= 0x80:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    out.append(value)
    return bytes(out)


def fields(data: bytes):
    """(field number, wire type, value, raw bytes of the whole field), in file order."""
    at = 0
    while at < len(data):
        begin = at
        key, at = _varint(data, at)
        kind = key & 7
        if kind == VARINT:
            value, at = _varint(data, at)
        elif kind == BYTES:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        elif kind in (FIXED64, FIXED32):
            n = 8 if kind == FIXED64 else 4
            value, at = data[at : at + n], at + n
        else:
            raise ValueError(f"unknown wire type {kind}")
        yield key >> 3, kind, value, data[begin:at]


@dataclass(frozen=True)
class NormalizerSpec:
    charsmap: bytes = b""
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True


def normalizer_spec(model: bytes) -> NormalizerSpec:
    found: dict[int, object] = {}
    for number, _, value, _ in fields(model):
        if number == MODEL_NORMALIZER:
            found.update({n: v for n, _, v, _ in fields(value)})
    return NormalizerSpec(
        bytes(found.get(SPEC_CHARSMAP, b"")),
        bool(found.get(SPEC_DUMMY_PREFIX, 1)),
        bool(found.get(SPEC_REMOVE_EXTRA, 1)),
        bool(found.get(SPEC_ESCAPE, 1)),
    )


def without_normalizer(model: bytes) -> bytes:
    """The same model, whose normaliser hands text on unchanged."""
    spec = b"".join(_put(n << 3) + _put(0) for n in (SPEC_DUMMY_PREFIX, SPEC_REMOVE_EXTRA, SPEC_ESCAPE))
    kept = b"".join(raw for n, _, _, raw in fields(model) if n not in (MODEL_NORMALIZER, MODEL_DENORMALIZER))
    return kept + _put(MODEL_NORMALIZER << 3 | BYTES) + _put(len(spec)) + spec
