"""Progressive JPEG: writing and reading with numpy, and a payload kept in coefficients.

Reading accumulates spectral-selection and successive-approximation scans into
coefficient arrays, transforms them back in numpy, upsamples chroma and gives a
full-resolution RGB tensor. The reader takes any baseline-Huffman progressive
file of one or three components; scans whose codes all have the same length, as
the writer here makes them, are read for all blocks at once.

A payload is stored without loss in the format's own unit, the quantised
coefficient: byte b is the coefficient whose JPEG magnitude category is 8 and
whose extra bits are b itself (b from 128 on stands for b, a smaller one for
b - 255), 64 to a block. Files have a luma component, which takes the first two thirds
of the payload's blocks, and two of chroma at half its resolution either way, so the
tensor is made by upsampling and colour conversion as that of any colour file.

Defined results: a null or empty text is one block of zero bytes. Repeated rows
give repeated equal rows; extra input columns are ignored; an empty table gives
an empty table. Blocks that fill up the last row of an image hold byte 0; the
payload's length stands in a comment segment.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, split_columns, text_or_empty

BLOCK = 64
#: Blocks that are transformed at once: bounds memory for very long texts.
CHUNK_BLOCKS = 4096
MAX_SIDE_MCUS = 4095  # of 16 samples a side: 65,535 at most
#: Pixels whose colours are converted at once.
CHUNK_PIXELS = 1 << 18
COMMENT = b"payload "

# JPEG markers (ITU-T T.81, table B.1).
SOI, EOI, SOS, DQT, DHT, DRI, COM, SOF2, RST0 = 0xD8, 0xD9, 0xDA, 0xDB, 0xC4, 0xDD, 0xFE, 0xC2, 0xD0


def zigzag() -> np.ndarray:
    """Natural index of each zigzag position: anti-diagonals in turn, every other one upwards."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (sum(x), x[0] if sum(x) % 2 else x[1]))
    return np.array([8 * r + c for r, c in cells])


def dct_basis() -> np.ndarray:
    """64x64 matrix from coefficients in zigzag order to samples of a block."""
    u = np.arange(8)
    one = np.cos((2 * u[:, None] + 1) * u * np.pi / 16) / 2
    one[:, 0] /= np.sqrt(2)
    return np.kron(one, one)[:, zigzag()].T.astype(np.float32)


ZIGZAG = zigzag()
BASIS = dct_basis()


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


# ---------------------------------------------------------------- payload

# The Huffman tables of payload files as (code length, symbol). One code each, all zero bits.
DC_CODE = (8, 0x08)  # category 8
AC_FIRST_CODE = (1, 0x07)  # run 0, category 7
AC_LAST_CODE = (1, 0x00)  # end of block: only correction bits follow


def _huffman_segment(kind: int, code: tuple[int, int]) -> bytes:
    counts = bytes(int(n == code[0]) for n in range(1, 17))
    return _segment(DHT, bytes([kind << 4]) + counts + bytes([code[1]]))


def _scan(component: int, first: int, last: int, high: int, low: int) -> bytes:
    return _segment(SOS, bytes([1, component, 0, first, last, high << 4 | low]))


#: Components of payload files as (sampling, blocks of a minimum coded unit).
COMPONENTS = ((0x22, 4), (0x11, 1), (0x11, 1))


def write_payload(payload: bytes) -> bytes:
    """A progressive YCbCr JPEG (4:2:0) whose coefficients are the payload's bytes (their number a positive multiple of 64)."""
    n = len(payload) // BLOCK
    mcus = -(-n // sum(blocks for _, blocks in COMPONENTS))
    width = min(mcus, max(8, -(-mcus // MAX_SIDE_MCUS)))
    height = -(-mcus // width) if mcus else 0
    if not n or len(payload) % BLOCK or width > MAX_SIDE_MCUS:
        raise ValueError(f"{len(payload)} bytes don't make one image")
    held = np.zeros((width * height * sum(blocks for _, blocks in COMPONENTS), BLOCK), np.uint8)
    held.reshape(-1)[: len(payload)] = np.frombuffer(payload, np.uint8)
    borders = np.cumsum([0, *(width * height * blocks for _, blocks in COMPONENTS)])
    parts = [held[at:to] for at, to in zip(borders, borders[1:], strict=False)]
    scans = [[], [], []]  # first values of DC, all but the lowest bit of AC, that bit
    for k, values in enumerate(parts, 1):
        # DC: a restart behind each block makes every difference the value itself: 8 zero bits, then b.
        dc = np.zeros((len(values), 4), np.uint8)
        dc[:, 1], dc[:, 2], dc[:, 3] = values[:, 0], 0xFF, RST0 + np.arange(len(values)) % 8
        units = dc.tobytes()[:-2] if 0xFF not in values[:, 0] else b"".join(r[:2].replace(b"\xff", b"\xff\0") + r[2:] for r in map(bytes, dc))[:-2]
        # AC without the lowest magnitude bit: one zero bit, then b >> 1. AC lowest bits: one zero bit, then 63 corrections;
        # a negative value's magnitude is 255 - b, so its bit is turned round.
        ac = values[:, 1:]
        bits = np.zeros(values.shape, np.uint8)
        bits[:, 1:] = (ac ^ (ac >> 7) ^ 1) & 1
        scans[0] += [_scan(k, 0, 0, 0, 0), units]
        scans[1] += [_scan(k, 1, 63, 0, 1), (ac >> 1).tobytes()]
        scans[2] += [_scan(k, 1, 63, 1, 0), np.packbits(bits, axis=1).tobytes().replace(b"\xff", b"\xff\0")]
    frame = b"".join(bytes([k, sampling, 0]) for k, (sampling, _) in enumerate(COMPONENTS, 1))
    return b"".join([
        bytes([0xFF, SOI]), _segment(COM, COMMENT + str(len(payload)).encode()), _segment(DQT, b"\0" + b"\1" * BLOCK),
        _segment(SOF2, b"\x08" + (16 * height).to_bytes(2, "big") + (16 * width).to_bytes(2, "big") + bytes([len(COMPONENTS)]) + frame),
        _huffman_segment(0, DC_CODE), _segment(DRI, b"\0\1"), *scans[0], _segment(DRI, b"\0\0"),
        _huffman_segment(1, AC_FIRST_CODE), *scans[1],
        _huffman_segment(1, AC_LAST_CODE), *scans[2],
        bytes([0xFF, EOI]),
    ])


def read_payload(image: Image) -> bytes:
    """The payload back from the coefficients."""
    n = int(next(c for c in image.comments if c.startswith(COMMENT))[len(COMMENT) :])
    return b"".join(np.where(c.coefficients < 0, c.coefficients + 255, c.coefficients).astype(np.uint8).tobytes() for c in image.components)[:n]


# ---------------------------------------------------------------- reader


class Component:
    def __init__(self, name: int, h: int, v: int, table: int) -> None:
        self.name, self.h, self.v, self.table = name, h, v, table
        self.dc = self.ac = 0
        self.pred = 0

    def size(self, image: Image) -> None:
        """Blocks that hold samples, and blocks in storage (whole minimum coded units)."""
        self.wide = -(-image.width * self.h // (8 * image.h))
        self.high = -(-image.height * self.v // (8 * image.v))
        self.stride = image.mcus_wide * self.h
        self.coefficients = np.zeros((self.stride * image.mcus_high * self.v, BLOCK), np.int16)


class Bits:
    """Bits of one restart interval; ones follow its end, as the format pads."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.have, self.word = data, 0, 0, 0

    def take(self, n: int) -> int:
        while self.have < n:
            self.word = self.word << 8 | (self.data[self.at] if self.at < len(self.data) else 0xFF)
            self.at += 1
            self.have += 8
        self.have -= n
        out = self.word >> self.have & (1 << n) - 1
        self.word &= (1 << self.have) - 1
        return out

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.take(1)
            if (n, code) in codes:
                return codes[n, code]
        raise ValueError("not a Huffman code")

    def signed(self, n: int) -> int:
        v = self.take(n) if n else 0
        return v if not n or v >> n - 1 else v - (1 << n) + 1


class Image:
    """A progressive JPEG's coefficients, and its pixels."""

    def __init__(self, data: bytes) -> None:
        self.tables: dict[int, np.ndarray] = {}
        self.codes: dict[tuple[int, int], dict] = {}
        self.comments: list[bytes] = []
        self.restart, at = 0, 2
        if data[:2] != bytes([0xFF, SOI]):
            raise ValueError("not a JPEG file")
        while at < len(data):
            if data[at] != 0xFF:
                raise ValueError("a marker was expected")
            marker = data[at + 1]
            at += 2
            if marker == EOI:
                break
            if marker == 0xFF:
                at -= 1
                continue
            n = int.from_bytes(data[at : at + 2], "big")
            body, at = data[at + 2 : at + n], at + n
            if marker == COM:
                self.comments.append(body)
            elif marker == DQT:
                self._quantisers(body)
            elif marker == DHT:
                self._huffman(body)
            elif marker == DRI:
                self.restart = int.from_bytes(body, "big")
            elif marker == SOF2:
                self._frame(body)
            elif marker == SOS:
                end = at
                while True:  # entropy-coded data end at a marker that isn't a restart
                    end = data.find(b"\xff", end)
                    if end < 0 or end + 1 >= len(data):
                        end = len(data)
                        break
                    if data[end + 1] and not RST0 <= data[end + 1] <= RST0 + 7:
                        break
                    end += 2
                self._scan(body, data[at:end])
                at = end
            elif 0xC0 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
                raise ValueError("only progressive Huffman files are read")

    def _quantisers(self, body: bytes) -> None:
        while body:
            wide = body[0] >> 4
            self.tables[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else "u1").astype(np.float32)
            body = body[65 + 64 * wide :]

    def _huffman(self, body: bytes) -> None:
        while body:
            counts, code, at, codes = body[1:17], 0, 17, {}
            for n, count in enumerate(counts, 1):
                for _ in range(count):
                    codes[n, code] = body[at]
                    code, at = code + 1, at + 1
                code <<= 1
            self.codes[body[0] >> 4, body[0] & 15] = codes
            body = body[at:]

    def _frame(self, body: bytes) -> None:
        self.height, self.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
        self.components = [Component(c[0], c[1] >> 4, c[1] & 15, c[2]) for c in (body[6 + 3 * i : 9 + 3 * i] for i in range(body[5]))]
        self.h, self.v = max(c.h for c in self.components), max(c.v for c in self.components)
        self.mcus_wide, self.mcus_high = -(-self.width // (8 * self.h)), -(-self.height // (8 * self.v))
        for c in self.components:
            c.size(self)

    def _scan(self, body: bytes, data: bytes) -> None:
        own = []
        for i in range(body[0]):
            c = next(c for c in self.components if c.name == body[1 + 2 * i])
            c.dc, c.ac = body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15
            own.append(c)
        first, last, how = body[1 + 2 * body[0] : 4 + 2 * body[0]]
        if len(own) == 1 and self._uniform(own[0], first, last, how, data):
            return
        if len(own) == 1:
            c = own[0]
            units = [[(c, y * c.stride + x)] for y in range(c.high) for x in range(c.wide)]
        else:
            units = [[(c, (my * c.v + y) * c.stride + mx * c.h + x) for c in own for y in range(c.v) for x in range(c.h)] for my in range(self.mcus_high) for mx in range(self.mcus_wide)]
        parts = self._intervals(data) if self.restart else [data]
        step = self.restart or len(units)
        for i, part in enumerate(parts):
            bits, self.run = Bits(part.replace(b"\xff\0", b"\xff")), 0
            for c in own:
                c.pred = 0
            for unit in units[i * step : (i + 1) * step]:
                for c, block in unit:
                    self._block(c, c.coefficients[block], bits, first, last, how >> 4, how & 15)

    @staticmethod
    def _intervals(data: bytes) -> list[bytes]:
        out, begin, at = [], 0, data.find(b"\xff")
        while at >= 0:
            if data[at + 1 : at + 2] > b"\0":
                out.append(data[begin:at])
                begin = at + 2
            at = data.find(b"\xff", at + 2)
        return [*out, data[begin:]]

    def _uniform(self, c: Component, first: int, last: int, how: int, data: bytes) -> bool:
        """Scans of the payload layout, for all blocks at once. False: any other scan."""
        n = len(c.coefficients)
        if c.wide != c.stride or c.wide * c.high != n:
            return False
        one = lambda kind, number: next(((k, v) for k, v in self.codes.get((kind, number), {}).items()), None) if len(self.codes.get((kind, number), {})) == 1 else None
        if (first, last, how) == (0, 0, 0) and self.restart == 1 and one(0, c.dc) == ((8, 0), 8):
            units = np.frombuffer(data.replace(b"\xff\0", b"\xff") + b"\xff\xd0", np.uint8)
            if len(units) != 4 * n or units[0::4].any():
                return False
            v = units[1::4].astype(np.int16)
            c.coefficients[:, 0] = np.where(v < 128, v - 255, v)
            return True
        if (first, last, how) == (1, 63, 1) and not self.restart and one(1, c.ac) == ((1, 0), 7):
            v = np.frombuffer(data, np.uint8)
            if len(v) != 63 * n or (v > 127).any():
                return False
            v = v.reshape(n, 63).astype(np.int16)
            c.coefficients[:, 1:] = 2 * np.where(v < 64, v - 127, v)
            return True
        if (first, last, how) == (1, 63, 16) and not self.restart and one(1, c.ac) == ((1, 0), 0):
            v = np.frombuffer(data.replace(b"\xff\0", b"\xff"), np.uint8)
            if len(v) != 8 * n or (v[::8] > 127).any() or not c.coefficients[:, 1:].all():
                return False
            bits = np.unpackbits(v.reshape(n, 8), axis=1)[:, 1:].astype(np.int16)
            part = c.coefficients[:, 1:]
            part += np.where(part < 0, -bits, bits)
            return True
        return False

    def _block(self, c: Component, block: np.ndarray, bits: Bits, first: int, last: int, high: int, low: int) -> None:
        if not first:
            if high:
                block[0] |= bits.take(1) << low
            else:
                c.pred += bits.signed(bits.symbol(self.codes[0, c.dc]))
                block[0] = c.pred << low
            return
        codes, k = self.codes[1, c.ac], first
        if not high:
            if self.run:
                self.run -= 1
                return
            while k <= last:
                run, size = divmod(bits.symbol(codes), 16)
                if not size and run < 15:
                    self.run = (1 << run) - 1 + (bits.take(run) if run else 0)
                    return
                k += run
                if size:
                    block[k] = bits.signed(size) * (1 << low)
                k += 1
            return
        step = 1 << low

        def refine(at: int) -> None:
            if bits.take(1):
                block[at] += step if block[at] > 0 else -step

        if not self.run:
            while k <= last:
                run, size = divmod(bits.symbol(codes), 16)
                if not size and run < 15:
                    self.run = (1 << run) + (bits.take(run) if run else 0)
                    break
                value = (step if bits.take(1) else -step) if size else 0
                while k <= last:
                    if block[k]:
                        refine(k)
                    elif run:
                        run -= 1
                    else:
                        block[k] = value
                        k += 1
                        break
                    k += 1
        if self.run:
            for at in range(k, last + 1):
                if block[at]:
                    refine(at)
            self.run -= 1

    def plane(self, c: Component) -> np.ndarray:
        """Samples of one component, at its own resolution."""
        rows = len(c.coefficients) // c.stride
        out = np.empty((rows, 8, c.stride, 8), np.uint8)
        basis = self.tables[c.table][:, None] * BASIS
        per = max(1, CHUNK_BLOCKS // c.stride)
        for at in range(0, rows, per):
            part = c.coefficients[at * c.stride : (at + per) * c.stride].astype(np.float32) @ basis
            part += 128.5
            np.clip(part, 0, 255, out=part)
            out[at : at + per] = part.astype(np.uint8).reshape(-1, c.stride, 8, 8).swapaxes(1, 2)
        return out.reshape(rows * 8, c.stride * 8)

    def rgb(self) -> np.ndarray:
        """Full-resolution (height, width, 3) tensor. Chroma is repeated up to the size of luma."""
        planes = []
        for c in self.components:
            p = self.plane(c)
            p = p.repeat(self.v // c.v, axis=0).repeat(self.h // c.h, axis=1) if (self.v, self.h) != (c.v, c.h) else p
            planes.append(p[: self.height, : self.width])
        if len(planes) == 1:
            return np.broadcast_to(planes[0][:, :, None], (self.height, self.width, 3))
        out = np.empty((self.height, self.width, 3), np.uint8)
        step = max(1, CHUNK_PIXELS // self.width)
        for at in range(0, self.height, step):
            y, cb, cr = (p[at : at + step].astype(np.float32) for p in planes)
            cb -= 128
            cr -= 128
            # ITU-R BT.601 full range, as JFIF has it.
            for k, channel in enumerate((y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb)):
                channel += 0.5
                out[at : at + step, :, k] = np.clip(channel, 0, 255, out=channel)
        return out


# ---------------------------------------------------------------- columns


def features(rgb: np.ndarray) -> str:
    """Size, then for each channel mean, deviation and an 8-bin histogram in thousandths."""
    height, width, _ = rgb.shape
    out = [f"{width}x{height}"]
    channels = [rgb[:, :, 0]] if rgb.strides[2] == 0 else [rgb[:, :, i] for i in range(3)]
    for channel in channels:
        counts = np.bincount(channel.reshape(-1), minlength=256)
        n, level = counts.sum(), np.arange(256)
        mean = (counts * level).sum() / n
        out.append(f"{mean:.2f} {np.sqrt((counts * (level - mean) ** 2).sum() / n):.2f} " + "-".join(str(round(1000 * x / n)) for x in counts.reshape(8, 32).sum(axis=1).tolist()))
    return ";".join(out if len(out) > 2 else [out[0], *out[1:] * 3])


def padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % BLOCK if data else BLOCK)


#: What store_texts can return, with the SQL type of each.
OUTPUTS = {
    "n_bytes": "long", "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string",
    "media": "binary", "height": "int", "width": "int", "rgb": "binary",
}


def store_texts(df: DataFrame, outputs: tuple[str, ...] = tuple(OUTPUTS), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Store every whole text as a progressive JPEG, read it back, and return columns of OUTPUTS.

    media is the file; rgb the tensor's bytes, (height, width, 3). All other columns are
    taken from what was read back, but for n_bytes, the text's own length.
    """
    bounded_batches(df.sparkSession)
    key_type = df.schema[key].dataType.simpleString()

    def row(text_bytes: bytes) -> dict:
        media = write_payload(padded(text_bytes))
        image = Image(media)
        payload, rgb = read_payload(image), image.rgb()
        out = {"n_bytes": len(text_bytes), "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-BLOCK:])}
        out |= {"media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "feature": features(rgb), "height": rgb.shape[0], "width": rgb.shape[1]}
        return out | ({"media": media} if "media" in outputs else {}) | ({"rgb": rgb.tobytes()} if "rgb" in outputs else {})

    def run(batches):
        import pyarrow as pa

        arrow = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
        for batch in batches:
            for keys, texts in split_columns(batch, [key, text], 256):
                rows = [row(t) for t in texts]
                columns = [pa.array([r[o] for r in rows], arrow[OUTPUTS[o]]) for o in outputs]
                yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(key).type), *columns], names=[key, *outputs])

    schema = ", ".join([f"`{key}` {key_type}", *(f"{o} {OUTPUTS[o]}" for o in outputs)])
    return df.select(F.col(key), text_or_empty(text).alias(text)).mapInArrow(run, schema)


def decode_images(df: DataFrame, key: str = "image_id", media: str = "media") -> DataFrame:
    """(key, height, width, rgb) of progressive JPEG files; nulls for a null or one that can't be read."""
    key_type = df.schema[key].dataType.simpleString()

    def read(data: bytes | None):
        try:
            rgb = Image(data).rgb()
        except (TypeError, ValueError, KeyError, IndexError, AttributeError, StopIteration):
            return None, None, None
        return rgb.shape[0], rgb.shape[1], rgb.tobytes()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for keys, files in split_columns(batch, [key, media], 16):
                h, w, t = zip(*map(read, files), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(key).type), pa.array(h, pa.int32()), pa.array(w, pa.int32()), pa.array(t, pa.binary())], names=[key, "height", "width", "rgb"])

    return df.select(key, F.col(media).cast("binary").alias(media)).mapInArrow(run, f"`{key}` {key_type}, height int, width int, rgb binary")


def op5_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return store_texts(docs, ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"))
