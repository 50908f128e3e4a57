"""Media columns: baseline JPEG.

`encode` stores bytes losslessly as the DC values of a greyscale baseline JPEG: one flat 8x8 block per byte, quantiser 8, so
that the sample of a block is the byte itself; a restart marker follows every row of blocks. `decode` reads any baseline
JPEG: it parses the markers, Huffman-decodes the scan of all images and restart intervals in step in numpy, and rebuilds
the luminance thumbnail, one pixel per block, from the DC values alone.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import bounded_batches

UNIT = 192
COLUMNS = 192  # blocks in a row
ROWS = 8191  # a JPEG is at most 65535 pixels high
INTERVAL = 192
STEP = 65_536  # intervals decoded at a time

# Fixed values of the format: the customary luminance DC code (lengths 1..16, symbols), and the zigzag-free parts we write.
DC_COUNTS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)
DC_SYMBOLS = tuple(range(12))
AC_COUNTS = (1,) + (0,) * 15
AC_SYMBOLS = (0,)


def codes(counts, symbols) -> dict[int, tuple[int, int]]:
    """Symbol to (code, length), canonical."""
    out, code, k = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[symbols[k]] = code, length
            code, k = code + 1, k + 1
        code <<= 1
    return out


def lookup(counts, symbols) -> np.ndarray:
    """For each 16 bits ahead: length * 256 + symbol; 0 where no code begins so."""
    out = np.zeros(65536, np.int32)
    for s, (code, length) in codes(counts, symbols).items():
        out[code << (16 - length) : (code + 1) << (16 - length)] = length * 256 + s
    return out


def _diff_codes() -> tuple[np.ndarray, np.ndarray]:
    """Bits and their number of a block by its DC difference + 255: code, magnitude, end of block."""
    dc, (eob, eob_n) = codes(DC_COUNTS, DC_SYMBOLS), codes(AC_COUNTS, AC_SYMBOLS)[0]
    bits, n = np.zeros(511, np.int64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, length = dc[size]
        bits[d + 255] = ((code << size | (d if d >= 0 else d + (1 << size) - 1)) << eob_n) | eob
        n[d + 255] = length + size + eob_n
    return bits, n


_BITS, _LENGTHS = _diff_codes()
_MARKS = [bytes((255, 0xD0 + i)) for i in range(8)]


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


_HEAD = b"\xff\xd8" + _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + _segment(0xDB, b"\0" + bytes([8] * 64))
_TAIL = _segment(0xC4, b"\0" + bytes(DC_COUNTS) + bytes(DC_SYMBOLS)) + _segment(0xC4, b"\x10" + bytes(AC_COUNTS) + bytes(AC_SYMBOLS)) + _segment(0xDD, struct.pack(">H", INTERVAL)) + _segment(0xDA, b"\1\1\0\0\x3f\0")


def _header(n: int) -> bytes:
    return _HEAD + _segment(0xC0, struct.pack(">BHHB", 8, 8 * (n // COLUMNS), 8 * COLUMNS, 1) + b"\1\x11\0") + _TAIL


def encode(payloads: list[bytes]) -> list[bytes]:
    """A JPEG for each payload (a positive multiple of UNIT bytes); one too long for an image is several in a row."""
    pieces = [(k, p[i : i + COLUMNS * ROWS]) for k, p in enumerate(payloads) for i in range(0, len(p), COLUMNS * ROWS)]
    data = np.frombuffer(b"".join(p for _, p in pieces), np.uint8).reshape(-1, INTERVAL)
    diff = np.diff(data.astype(np.int16), axis=1, prepend=np.int16(128)) + np.int16(255)
    bits, n = _BITS[diff], _LENGTHS[diff]
    for _ in range(2):  # four blocks, of 15 bits at most, to a word
        bits, n = bits[:, ::2] << n[:, 1::2] | bits[:, 1::2], n[:, ::2] + n[:, 1::2]
    total = n.sum(axis=1)
    size = (total + 7) // 8
    at = np.cumsum(size) - size
    place = ((8 * at)[:, None] + np.cumsum(n, axis=1) - n).ravel()
    bits, n = bits.ravel().astype(np.uint64), n.ravel()
    over = (place & 63) + n - 64  # bits that belong to the next word
    high = np.where(over > 0, bits >> np.maximum(over, 0).astype(np.uint64), bits << np.maximum(-over, 0).astype(np.uint64))
    low = np.where(over > 0, bits << (64 - np.maximum(over, 1)).astype(np.uint64), np.uint64(0))
    word = place >> 6
    first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    out = np.zeros(int(size.sum()) // 8 + 2, np.uint64)
    out[word[first]] = np.add.reduceat(high, first)
    out[word[first] + 1] += np.add.reduceat(low, first)
    body = out.astype(">u8").view(np.uint8)
    body[at + size - 1] |= ((1 << (8 * size - total)) - 1).astype(np.uint8)  # the rest of the last byte is ones
    scans, ends, images, k = body.tobytes(), (at + size).tolist(), [b""] * len(payloads), 0
    begin = 0
    for owner, p in pieces:
        parts = [_header(len(p))]
        for i in range(len(p) // INTERVAL):
            parts.append(scans[begin : ends[k]].replace(b"\xff", b"\xff\0"))
            parts.append(_MARKS[i & 7])
            begin, k = ends[k], k + 1
        parts[-1] = b"\xff\xd9"
        images[owner] += b"".join(parts)
    return images


class Image:
    """What the markers of one baseline JPEG say, and its scan cut into restart intervals."""

    def __init__(self, data: bytes, at: int = 0) -> None:
        quant, huff, self.interval, components = {}, {}, 0, []
        if data[at : at + 2] != b"\xff\xd8":
            raise ValueError("not a JPEG")
        at += 2
        while True:
            while data[at + 1] == 0xFF:
                at += 1
            marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
            body, at = data[at + 4 : at + 2 + size], at + 2 + size
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    quant[body[0] & 15] = struct.unpack_from(">H" if wide else "B", body, 1)[0]
                    body = body[1 + 64 * (1 + wide) :]
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    huff[body[0]] = tuple(body[1:17]), tuple(body[17 : 17 + n])
                    body = body[17 + n :]
            elif marker == 0xDD:
                self.interval = struct.unpack(">H", body)[0]
            elif marker in (0xC0, 0xC1):
                bits, self.height, self.width, n = struct.unpack_from(">BHHB", body)
                if bits != 8:
                    raise ValueError("8-bit samples only")
                components = [tuple(body[6 + 3 * k : 9 + 3 * k]) for k in range(n)]
            elif 0xC0 < marker < 0xD0 and marker != 0xC8:
                raise ValueError("baseline only")
            elif marker == 0xDA:
                scan = {body[1 + 2 * k]: body[2 + 2 * k] for k in range(body[0])}
                break
        if set(scan) != {c[0] for c in components}:
            raise ValueError("one scan with all components only")
        alone = len(components) == 1
        self.h, self.v = (1, 1) if alone else (components[0][1] >> 4, components[0][1] & 15)
        self.h_max, self.v_max = (1, 1) if alone else (max(c[1] >> 4 for c in components), max(c[1] & 15 for c in components))
        self.columns, self.rows = -(-self.width // (8 * self.h_max)), -(-self.height // (8 * self.v_max))
        self.quant = quant[components[0][2]]
        #: the blocks of an MCU: component, DC table, AC table
        self.layout = tuple((k, huff[scan[c[0]] >> 4], huff[16 + (scan[c[0]] & 15)]) for k, c in enumerate(components) for _ in range(1 if alone else (c[1] >> 4) * (c[1] & 15)))
        end = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]").search(data, at)
        self.end = end.start() + 2 if end else len(data)
        self.parts = [x.replace(b"\xff\0", b"\xff") for x in re.split(rb"\xff[\xd0-\xd7]", data[at : end.start() if end else len(data)])]
        n = self.columns * self.rows
        self.mcus = [min(self.interval or n, n - k * (self.interval or n)) for k in range(len(self.parts))]


def decode_dc(layout: tuple, parts: list[bytes], mcus: list[int]) -> list[np.ndarray]:
    """The DC values of the first component's blocks in each interval: a block of all intervals at a time."""
    tables = {t: lookup(*t) for _, dc, ac in layout for t in (dc, ac)}
    out: list[np.ndarray] = []
    for lo in range(0, len(parts), STEP):
        own, count = parts[lo : lo + STEP], np.array(mcus[lo : lo + STEP])
        size = np.array([len(p) for p in own])
        raw = np.frombuffer(b"".join(own) + bytes(16), np.uint8)
        ahead = np.zeros(len(raw) - 8, np.uint64)  # the 64 bits from each byte on
        for k in range(8):
            ahead |= raw[k : k + len(ahead)].astype(np.uint64) << np.uint64(56 - 8 * k)
        limit = 8 * np.cumsum(size)
        live, pos, last = np.arange(len(own)), limit - 8 * size, count * len(layout)
        values = np.zeros((int(last.max()), len(own)), np.int32)
        pred = np.zeros((1 + max(c for c, _, _ in layout), len(own)), np.int64)
        for block in range(len(values)):
            if last[live].min() <= block:
                live = live[last[live] > block]
            component, dc, ac = layout[block % len(layout)]
            p = pos[live]
            bits = ahead[p >> 3] << (p & 7).astype(np.uint64)
            code = tables[dc][bits >> np.uint64(48)]
            n, s = code >> 8, code & 15
            # the magnitude, and then most often the end of the block
            mag = ((bits << n.astype(np.uint64)) >> np.uint64(1) >> (63 - s).astype(np.uint64)).astype(np.int64)
            diff = np.where(mag << 1 >> s, mag, mag - (1 << s) + 1)
            pred[component, live] += diff
            values[block, live] = pred[component, live]
            code2 = tables[ac][(bits << (n + s).astype(np.uint64)) >> np.uint64(48)]
            bad = (code == 0).any()
            p = p + n + s + (code2 >> 8) * ((code2 & 255) == 0)
            rest = np.flatnonzero((code2 & 255) != 0)
            k = np.ones(len(rest), np.int64)
            bad = bad or (code2 == 0).any()
            while len(rest) and not bad:  # AC values are passed over
                q = p[rest]
                code = tables[ac][(ahead[q >> 3] << (q & 7).astype(np.uint64)) >> np.uint64(48)]
                bad = (code == 0).any() or (q >= limit[live[rest]]).any()
                s, run = code & 15, code >> 4 & 15
                p[rest] = q + (code >> 8) + s
                k = np.where((s == 0) & (run < 15), 64, k + run + 1)
                rest, k = rest[k < 64], k[k < 64]
            if bad or (p > limit[live]).any():
                raise ValueError("damaged scan")
            pos[live] = p
        luma = np.flatnonzero(np.array([c for c, _, _ in layout]) == 0)
        turned = np.ascontiguousarray(values.T)
        for i, m in enumerate(count):
            out.append(turned[i, (np.arange(m)[:, None] * len(layout) + luma).ravel()] if len(layout) > 1 else turned[i, :m])
    return out


def decode(images: list[bytes]) -> list[list[tuple[int, int, np.ndarray]]]:
    """For each value: (width, height, thumbnail of the luminance) of the JPEGs that it holds one after another."""
    parsed: list[tuple[int, Image]] = []
    for k, data in enumerate(images):
        at = 0
        while at < len(data):
            parsed.append((k, image := Image(data, at)))
            at = image.end
    out: list[list] = [[] for _ in images]
    values: dict[int, list[np.ndarray]] = {}
    for layout in dict.fromkeys(x.layout for _, x in parsed):
        own = [(i, x) for i, (_, x) in enumerate(parsed) if x.layout == layout]
        dc = iter(decode_dc(layout, [p for _, x in own for p in x.parts], [m for _, x in own for m in x.mcus]))
        for i, x in own:
            values[i] = [next(dc) for _ in x.parts]
    for i, (k, x) in enumerate(parsed):
        pixel = np.clip((np.concatenate(values[i]) * x.quant + 4) // 8 + 128, 0, 255).astype(np.uint8)
        pixel = pixel.reshape(x.rows, x.columns, x.v, x.h).swapaxes(1, 2).reshape(x.rows * x.v, x.columns * x.h)
        # blocks beyond the edge only fill the last MCU; a block of a subsampled luminance covers more pixels
        down, right = 8 * x.v_max // x.v, 8 * x.h_max // x.h
        out[k].append((x.width, x.height, pixel[: -(-x.height // down), : -(-x.width // right)]))
    return out


_STEPS = np.arange(9)


def thumbnail_hashes(pixel: np.ndarray) -> tuple[int, int]:
    """64 bits each: cells over the mean of an 8x8 grid, and rises along the rows of an 8x9 grid; a cell is a mean."""
    r = _STEPS[:8] * pixel.shape[0] // 8
    bands = np.add.reduceat(pixel, r, axis=0, dtype=np.int64) / np.maximum(np.diff(r, append=pixel.shape[0]), 1)[:, None]
    cells = []
    for n in (8, 9):
        c = _STEPS[:n] * pixel.shape[1] // n
        cells.append(np.add.reduceat(bands, c, axis=1) / np.maximum(np.diff(c, append=pixel.shape[1]), 1))
    bits = lambda x: int.from_bytes(np.packbits(x).tobytes(), "big")
    return bits(cells[0] > cells[0].mean()), bits(cells[1][:, 1:] > cells[1][:, :-1])


def payload_of(text: str | None) -> tuple[bytes, int]:
    data = text.encode("utf-8", "surrogatepass") if text else b""
    return data + b" " * (-len(data) % UNIT or (0 if data else UNIT)), len(data)


INFO = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, width long, height long, feature string"
#: Bytes of payload that are encoded and decoded together.
TOGETHER = 1_000_000


def stored(texts: list[str | None]) -> tuple[list[int], list[bytes]]:
    """Unpadded sizes and JPEGs."""
    both = [payload_of(t) for t in texts]
    return [n for _, n in both], encode([p for p, _ in both]) if both else []


def read_back(media: list[bytes]) -> list[tuple]:
    """The columns of INFO after n_bytes, from the stored bytes alone."""
    rows = []
    for data, images in zip(media, decode(media), strict=True):
        payload = b"".join(t.tobytes() for _, _, t in images)
        marks = [f"{w}x{h}:" + ":".join(f"{x:016x}" for x in thumbnail_hashes(t)) for w, h, t in images]
        rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), images[0][0], sum(h for _, h, _ in images), ",".join(marks)))
    return rows


def round_trip(keep: bool):
    names = [x.split()[0] for x in INFO.split(", ")] + ["media"] * keep

    def store(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, texts, size = [], [], 0
            for t in [*batch, ""]:
                if texts and (size > TOGETHER or len(rows) + len(texts) == len(batch)):
                    n, media = stored(texts)
                    rows += [(k, *info, m) if keep else (k, *info) for k, info, m in zip(n, read_back(media), media, strict=True)]
                    texts, size = [], 0
                texts.append(t)
                size += len(t or "")
            yield pd.DataFrame(rows, columns=names)

    return store


def with_media(docs: DataFrame, text: str = "text", keep: bool = True) -> DataFrame:
    """Add `media_info`: what reading the text's stored JPEG back gives, and with `keep` the JPEG itself as `media`.

    Null and empty texts are 192 spaces. Texts of over 192 * 8191 bytes are several JPEGs in a row. Equal texts give equal
    values. Nothing is shuffled. Columns `media_info` and `media` of the input are replaced.
    """
    bounded_batches(docs.sparkSession)
    return docs.drop("media").withColumn("media_info", F.pandas_udf(round_trip(keep), INFO + ", media binary" * keep)(F.col(text)))
