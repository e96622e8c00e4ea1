"""Baseline JPEG as a media column: markers, Huffman scans, DC-only luminance thumbnails.

A payload is stored losslessly as the quantised coefficients of 8x8 grey blocks (one byte each, shifted by 128, with a
quantisation table of ones). Every block is its own restart interval, so many blocks are coded and decoded in step
with numpy; the decoder also takes files of other writers (no or longer restart intervals, colour, subsampling).
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = 576  # bytes: 9 blocks of 64 coefficients, a row of 3 x 3 blocks
PER_IMAGE = 2700  # units in one image; longer payloads take several images, one after another
GROUP_BYTES = 1 << 19  # payload bytes that are coded in one numpy step; larger groups leave the cache
ROWS = 128  # rows of an Arrow batch that are held in coded form at a time

#: Natural position of each coefficient in file order, built by walking the diagonals.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))


def _canonical(counts: Sequence[int], symbols: Sequence[int]) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length) of a Huffman table given as in a DHT segment."""
    table, code, at = {}, 0, 0
    for length, count in enumerate(counts, 1):
        for symbol in symbols[at: at + count]:
            table[symbol] = (code, length)
            code += 1
        at += count
        code <<= 1
    return table


#: Own tables by rule. DC: 12 sizes with 4 bits. AC: sizes 1-10 without a run with 4 bits, all others with 9 bits.
DC_SYMBOLS = list(range(12))
AC_SHORT = list(range(1, 11))
AC_LONG = [0x00, 0xF0, *(run << 4 | size for run in range(1, 16) for size in range(1, 11))]
DC_COUNTS = [0, 0, 0, 12] + [0] * 12
AC_COUNTS = [0, 0, 0, 10, 0, 0, 0, 0, len(AC_LONG)] + [0] * 7


def _lookup(counts: Sequence[int], symbols: Sequence[int]) -> np.ndarray:
    """For every 16-bit window: symbol << 8 | code length; 0 where no code fits."""
    table = np.zeros(1 << 16, np.int64)
    for symbol, (code, length) in _canonical(counts, symbols).items():
        table[code << (16 - length): (code + 1) << (16 - length)] = symbol << 8 | length
    return table


def _dense(counts, symbols):
    codes, lengths = np.zeros(256, np.int64), np.zeros(256, np.int64)
    for symbol, (code, length) in _canonical(counts, symbols).items():
        codes[symbol], lengths[symbol] = code, length
    return codes, lengths


DC_CODE, DC_LENGTH = _dense(DC_COUNTS, DC_SYMBOLS)
AC_CODE, AC_LENGTH = _dense(AC_COUNTS, AC_SHORT + AC_LONG)
_VALUES = np.arange(256) - 128
SIZE = np.array([int(abs(v)).bit_length() for v in _VALUES])
EXTRA = np.where(_VALUES > 0, _VALUES, _VALUES + (1 << SIZE) - 1)


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _header(width: int, height: int) -> bytes:
    return b"".join([
        b"\xff\xd8",
        _segment(0xDB, b"\x00" + b"\x01" * 64),
        _segment(0xC0, b"\x08" + height.to_bytes(2, "big") + width.to_bytes(2, "big") + b"\x01\x01\x11\x00"),
        _segment(0xC4, b"\x00" + bytes(DC_COUNTS) + bytes(DC_SYMBOLS)),
        _segment(0xC4, b"\x10" + bytes(AC_COUNTS) + bytes(AC_SHORT + AC_LONG)),
        _segment(0xDD, b"\x00\x01"),
        _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00"),
    ])


def _scan(blocks: np.ndarray, restart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes of all blocks, each followed by its restart marker, and the end of each block."""
    n = len(blocks)
    rows, cols = np.nonzero(blocks[:, 1:] != 128)
    value = blocks[:, 1:][rows, cols]
    first = np.ones(len(rows), bool)
    first[1:] = rows[1:] != rows[:-1]
    before = np.where(first, -1, np.concatenate([[-1], cols[:-1]])) if len(rows) else cols
    run = cols - before - 1
    zrl = run >> 4
    last = np.full(n, -1)
    last[rows] = cols  # assignments run in order, so the last column of the row stays
    eob = last < 62
    per_row = 1 + np.bincount(rows, 1 + zrl, n).astype(np.int64) + eob
    start = np.concatenate([[0], np.cumsum(per_row)])
    codes, lengths = np.zeros(start[-1], np.int64), np.zeros(start[-1], np.int64)
    size = SIZE[blocks[:, 0]]
    codes[start[:-1]] = DC_CODE[size] << size | EXTRA[blocks[:, 0]]
    lengths[start[:-1]] = DC_LENGTH[size] + size
    ends = start[1:][eob] - 1
    codes[ends], lengths[ends] = AC_CODE[0], AC_LENGTH[0]
    done = np.cumsum(1 + zrl)
    ahead = np.concatenate([[0], done])[np.searchsorted(rows, np.arange(n))]  # fields of earlier rows
    at = start[rows] + done - ahead[rows]
    size = SIZE[value]
    symbol = (run & 15) << 4 | size
    codes[at] = AC_CODE[symbol] << size | EXTRA[value]
    lengths[at] = AC_LENGTH[symbol] + size
    for step in range(1, int(zrl.max(initial=0)) + 1):
        more = at[zrl >= step] - step
        codes[more], lengths[more] = AC_CODE[0xF0], AC_LENGTH[0xF0]
    ended = np.cumsum(lengths)
    begun = ended - lengths
    bits = ended[start[1:] - 1] - begun[start[:-1]]
    size = (bits + 7) >> 3
    byte = np.concatenate([[0], np.cumsum(size)])
    at = begun + np.repeat(byte[:-1] * 8 - begun[start[:-1]], per_row)
    window = codes << (32 - lengths - (at & 7))
    at >>= 3
    packed = np.zeros(byte[-1] + 4)
    for k in range(4):
        packed += np.bincount(at + k, (window >> (24 - 8 * k)) & 255, len(packed))
    packed = packed[: byte[-1]].astype(np.uint8)
    packed[byte[1:] - 1] |= ((1 << ((-bits) & 7)) - 1).astype(np.uint8)
    stuffed = packed == 255
    move = np.arange(len(packed)) + np.cumsum(stuffed) - stuffed + 2 * np.repeat(np.arange(n), size)
    ends = move[byte[1:] - 1] + 1 + stuffed[byte[1:] - 1]
    out = np.zeros(int(ends[-1]) + 2, np.uint8)
    out[move] = packed
    out[ends], out[ends + 1] = 0xFF, 0xD0 + restart
    return out, ends


def encode_payloads(payloads: Sequence[bytes]) -> list[bytes]:
    """JPEG files (concatenated, where a payload needs more than one) of payloads of a multiple of ``UNIT`` bytes."""
    out: list[bytes] = []
    group: list[bytes] = []
    for payload in payloads:
        group.append(payload)
        if sum(map(len, group)) >= GROUP_BYTES:
            out += _encode_group(group)
            group = []
    return out + (_encode_group(group) if group else [])


def _encode_group(group: list[bytes]) -> list[bytes]:
    images = [[p[i: i + PER_IMAGE * UNIT] for i in range(0, len(p), PER_IMAGE * UNIT)] for p in group]
    counts = [len(image) // 64 for parts in images for image in parts]
    blocks = np.frombuffer(b"".join(group), np.uint8).reshape(-1, 64)
    index = np.arange(len(blocks)) - np.repeat(np.cumsum(counts) - counts, counts)
    scan, ends = _scan(blocks, index % 8)
    data, out, done = scan.tobytes(), [], 0
    for parts in images:
        files = []
        for image in parts:
            n = len(image) // 64
            begin = int(ends[done - 1]) + 2 if done else 0
            files += [_header(24, n // 3 * 8), data[begin: int(ends[done + n - 1])], b"\xff\xd9"]
            done += n
        out.append(b"".join(files))
    return out


@dataclass
class Image:
    """One parsed file: frame, tables and the byte ranges of its restart intervals."""

    width: int = 0
    height: int = 0
    components: list = field(default_factory=list)  # [id, h, v, quantisation, dc, ac]
    quantisation: dict = field(default_factory=dict)
    tables: dict = field(default_factory=dict)
    interval: int = 0
    scan: np.ndarray | None = None  # without stuffing
    segments: np.ndarray | None = None  # start of each restart interval in scan

    @property
    def mcus(self) -> tuple[int, int]:
        h, v = max(c[1] for c in self.components), max(c[2] for c in self.components)
        return -(-self.width // (8 * h)), -(-self.height // (8 * v))


def parse(data: bytes) -> list[Image]:
    """All images of the concatenated files. ValueError for anything but whole baseline files."""
    images, image, at = [], None, 0
    while at < len(data):
        if data[at] != 0xFF or at + 1 >= len(data):
            raise ValueError(f"marker expected at byte {at}")
        marker = data[at + 1]
        at += 2
        if marker == 0xFF:
            at -= 1
        elif marker == 0xD8:
            image = Image()
        elif marker == 0xD9:
            if image is None or image.scan is None:
                raise ValueError("end of image without a scan")
            images.append(image)
            image = None
        else:
            size = int.from_bytes(data[at: at + 2], "big")
            body = data[at + 2: at + size]
            if image is None or size < 2 or len(body) != size - 2:
                raise ValueError("truncated file")
            at += size
            if marker == 0xDB:
                while body:
                    wide = 1 + (body[0] >> 4)
                    table = np.frombuffer(body[1: 1 + 64 * wide], ">u2" if wide == 2 else np.uint8)
                    image.quantisation[body[0] & 15], body = table, body[1 + 64 * wide:]
            elif marker == 0xC0:
                if body[0] != 8:
                    raise ValueError("8-bit samples expected")
                image.height, image.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
                image.components = [[*(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]), 0, 0]
                                    for i in range(6, 6 + 3 * body[5], 3)]
            elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                raise ValueError("not a baseline file")
            elif marker == 0xC4:
                while body:
                    total = sum(body[1:17])
                    image.tables[body[0]], body = (body[1:17], body[17: 17 + total]), body[17 + total:]
            elif marker == 0xDD:
                image.interval = int.from_bytes(body[:2], "big")
            elif marker == 0xDA:
                named = {body[i]: body[i + 1] for i in range(1, 1 + 2 * body[0], 2)}
                if set(named) != {c[0] for c in image.components}:
                    raise ValueError("one interleaved scan expected")
                for part in image.components:
                    part[4], part[5] = named[part[0]] >> 4, named[part[0]] & 15
                at += _cut_scan(image, np.frombuffer(data, np.uint8, offset=at))
    if image is not None:
        raise ValueError("truncated file")
    return images


def _cut_scan(image: Image, rest: np.ndarray) -> int:
    """Find the end of the scan and its restart markers, take out stuffed zeros; bytes used."""
    marks = np.flatnonzero(rest[:-1] == 0xFF)
    after = rest[marks + 1]
    stop = marks[(after != 0) & ~((after >= 0xD0) & (after <= 0xD7))]
    if not len(stop):
        raise ValueError("truncated scan")
    end = int(stop[0])
    marks, after = marks[marks < end], after[marks < end]
    keep = np.ones(end, bool)
    keep[marks[after == 0] + 1] = False
    resets = marks[after != 0]
    keep[resets] = keep[resets + 1] = False
    image.scan = rest[:end][keep]
    kept = np.cumsum(keep)
    image.segments = np.concatenate([[0], kept[resets]])
    return end


def coefficients(images: Sequence[Image]) -> list[list[np.ndarray]]:
    """Quantised coefficients in file order of each component of each image: arrays (blocks in MCU order, 64).

    All restart intervals of images with the same tables and layout are decoded in step.
    """
    out: list = [None] * len(images)
    alike: dict = {}
    for k, image in enumerate(images):
        layout = tuple((c[1], c[2], image.tables[c[4]], image.tables[0x10 | c[5]]) for c in image.components)
        alike.setdefault(layout, []).append(k)
    for layout, group in alike.items():
        single = len(layout) == 1
        pattern = np.array([c for c, (h, v, _, _) in enumerate(layout) for _ in range(1 if single else h * v)])
        luts = np.stack([_cached(*layout[c][2 + ac]) for c in range(len(layout)) for ac in (0, 1)])
        scans, starts, sizes, limits, base = [], [], [], [], 0
        for k in group:
            image = images[k]
            if single:
                image.components[0][1] = image.components[0][2] = 1
            total = image.mcus[0] * image.mcus[1]
            step = image.interval or total
            n = -(-total // step)
            if len(image.segments) != n:
                raise ValueError("restart intervals do not match the frame")
            starts.append(image.segments + base)
            limits.append(np.append(image.segments[1:], len(image.scan)) + base)
            sizes.append(np.minimum(step, total - step * np.arange(n)) * len(pattern))
            scans.append(image.scan)
            base += len(image.scan)
        blocks = _decode(np.concatenate(scans), np.concatenate(starts), np.concatenate(limits),
                         np.concatenate(sizes), pattern, luts)
        done = 0
        for k in group:
            n = images[k].mcus[0] * images[k].mcus[1] * len(pattern)
            part = blocks[done: done + n].reshape(-1, len(pattern), 64)
            out[k] = [part[:, pattern == c].reshape(-1, 64) for c in range(len(layout))]
            done += n
    return out


@lru_cache(64)
def _cached(counts: bytes, symbols: bytes) -> np.ndarray:
    return _lookup(counts, symbols)


def _decode(scan, start, limit, blocks, pattern, luts) -> np.ndarray:
    """Huffman-decode the segments of ``scan`` side by side, one symbol of each at a time."""
    padded = np.concatenate([scan, np.full(8, 255, np.uint8)]).astype(np.uint64)
    window = np.zeros(len(padded) - 4, np.uint64)
    for k in range(5):
        window = window << np.uint64(8) | padded[k: len(padded) - 4 + k]
    window = window.astype(np.int64)
    out = np.zeros((int(blocks.sum()), 64), np.int16)
    flat = out.reshape(-1)
    row = np.cumsum(blocks) - blocks
    end = row + blocks
    k = np.zeros(len(start), np.int64)
    phase = np.zeros(len(start), np.int64)
    before = np.zeros((len(start), len(luts) // 2), np.int64)
    at = start.astype(np.int64) * 8
    limit = limit.astype(np.int64) * 8
    ids = np.arange(len(start))
    live = ids[blocks > 0]
    at, limit, row, end, k, phase, ids = (x[live] for x in (at, limit, row, end, k, phase, ids))
    simple = len(pattern) == 1
    while len(ids):
        here = window[np.minimum(at >> 3, len(window) - 1)]
        shift = at & 7
        part = pattern[phase] if not simple else 0
        entry = luts[part * 2 + (k > 0), (here >> (24 - shift)) & 0xFFFF]
        length, symbol = entry & 255, entry >> 8
        size, run = symbol & 15, symbol >> 4
        extra = (here >> (40 - shift - length - size)) & ((1 << size) - 1)
        value = np.where(extra < (1 << size >> 1), extra - (1 << size) + 1, extra)
        at = at + length + size
        if (length == 0).any() or (at > limit).any():
            raise ValueError("corrupt scan")
        dc = k == 0
        skip = ~dc & (size == 0)
        stop = skip & (run < 15)
        if dc.any():
            which = ids[dc], (part if simple else part[dc])
            before[which] += value[dc]
            value[dc] = before[which]
            run = np.where(dc, 0, run)
        k = k + run
        write = ~skip
        if (k[write] > 63).any():
            raise ValueError("corrupt scan")
        flat[(row * 64 + k)[write]] = value[write]
        k = np.where(stop, 64, k + 1)
        full = k >= 64
        if full.any():
            row = row + full
            k[full] = 0
            if not simple:
                phase = np.where(full, (phase + 1) % len(pattern), phase)
            live = row < end
            if not live.all():
                at, limit, row, end, k, phase, ids = (x[live] for x in (at, limit, row, end, k, phase, ids))
    return out


def thumbnail(image: Image, luminance: np.ndarray) -> np.ndarray:
    """One grey pixel per luminance block, from its DC coefficient alone; cut to the frame."""
    part = image.components[0]
    across, down = image.mcus
    h, v = part[1], part[2]
    dc = luminance[:, 0].astype(np.int64) * int(image.quantisation[part[3]][0])
    pixels = np.clip((dc + 1024 + 4) >> 3, 0, 255).astype(np.uint8)
    grid = pixels.reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
    most_h, most_v = max(c[1] for c in image.components), max(c[2] for c in image.components)
    return grid[: -(-image.height * v // (8 * most_v)), : -(-image.width * h // (8 * most_h))]


def difference_hash(pixels: np.ndarray) -> str:
    """64 bits: is a cell of the 8 x 9 box-averaged thumbnail darker than its right neighbour?"""
    rows = np.linspace(0, pixels.shape[0], 9)
    cols = np.linspace(0, pixels.shape[1], 10)
    total = np.zeros((pixels.shape[0] + 1, pixels.shape[1] + 1), np.int64)
    total[1:, 1:] = pixels.astype(np.int64).cumsum(0).cumsum(1)
    top, left = rows[:-1].astype(int), cols[:-1].astype(int)
    low, right = np.maximum(np.ceil(rows[1:]).astype(int), top + 1), np.maximum(np.ceil(cols[1:]).astype(int), left + 1)
    sums = total[np.ix_(low, right)] - total[np.ix_(top, right)] - total[np.ix_(low, left)] + total[np.ix_(top, left)]
    mean = sums / ((low - top)[:, None] * (right - left)[None, :])
    return np.packbits(mean[:, :-1] < mean[:, 1:]).tobytes().hex()


def describe(files: Sequence[bytes | None]) -> list[tuple | None]:
    """(payload, images, width, height, thumbnail hash, difference hash) of each file; None where it can't be read."""
    out: list[tuple | None] = []
    group, held = [], 0
    for data in files:
        group.append(data)
        held += len(data or b"")
        if held >= GROUP_BYTES:
            out += _describe_group(group)
            group, held = [], 0
    return out + (_describe_group(group) if group else [])


def _describe_group(files: Sequence[bytes | None]) -> list[tuple | None]:
    parsed = []
    for data in files:
        try:
            parsed.append(parse(data) if data else None)
        except (ValueError, IndexError, KeyError):
            parsed.append(None)
    images = [image for part in parsed for image in part or ()]
    try:
        found = coefficients(images)
    except (ValueError, KeyError):  # a bad scan among them: one file at a time, so only that file is lost
        if len(files) == 1:
            return [None]
        return [row for data in files for row in _describe_group([data])]
    out, at = [], 0
    for part in parsed:
        if not part:
            out.append(None)
            continue
        mine, at = found[at: at + len(part)], at + len(part)
        payload = b"".join((blocks[0] + 128).astype(np.uint8).tobytes() for blocks in mine)
        thumbs = [thumbnail(image, blocks[0]) for image, blocks in zip(part, mine)]
        digest = hashlib.sha256(b"".join(t.tobytes() for t in thumbs)).hexdigest()
        out.append((payload, len(part), part[0].width, sum(image.height for image in part), digest,
                    difference_hash(thumbs[0])))
    return out


def padded(text: bytes | None) -> bytes:
    """The bytes of a text, followed by bytes 255 up to a positive multiple of ``UNIT``."""
    text = text or b""
    return text + b"\xff" * (max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


def _store(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        for begin in range(0, len(texts), ROWS):
            yield pd.Series(encode_payloads([padded(text) for text in texts.iloc[begin: begin + ROWS]]), dtype=object)


READ = ("payload_bytes long, payload_sha256 string, tail_crc32 long, images int, width int, height int, "
        "thumb_sha256 string, thumb_hash string")


def _read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    names = [part.split()[0] for part in READ.split(", ")]
    for whole in batches:
        for begin in range(0, len(whole), ROWS):
            rows = []
            for row in describe(list(whole.iloc[begin: begin + ROWS])):
                if row is None:
                    rows.append((None,) * len(names))
                else:
                    payload, *rest = row
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), *rest))
            yield pd.DataFrame(rows, columns=names, dtype=object)


def store_texts(documents: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """Add ``media``: the text's bytes, padded, as baseline JPEG. Null: as an empty text (one unit of bytes 255).

    All other columns stay; a column named like ``media`` is replaced. One row at a time matters, so there is no
    shuffle and repeated rows or an empty table need no care; a text of any length is held once per row.
    """
    return documents.withColumn(media, F.pandas_udf(_store, "binary")(F.col(text).cast("binary")))


def read_media(frame: DataFrame, media: str = "media", info: str = "info") -> DataFrame:
    """Add the struct ``info``: the payload's size and digests, frame size and thumbnail hashes, read from ``media``.

    A null, truncated or non-baseline file gives a struct of nulls; other rows are not affected.
    """
    return frame.withColumn(info, F.pandas_udf(_read, READ)(F.col(media)))
