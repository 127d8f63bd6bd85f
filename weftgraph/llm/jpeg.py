"""Media columns as baseline JPEG: lossless payloads, a vectorised Huffman decoder and DC-only thumbnails.

Payload bytes are stored as quantised DCT coefficients, the format's unit: byte v is the coefficient whose eight magnitude
bits are v (v if it is 128 or more, else v - 255), so that one 8x8 block holds 64 bytes in scan order. Each block is a
restart interval, which makes it decodable for itself. A payload fills one or more images of three blocks a row, stored
one behind the other.

The decoder parses the markers of any baseline image (Huffman tables, sampling factors, restart intervals, one or several
scans) and decodes all restart intervals of a slice side by side, one symbol of each at a time, in numpy. Thumbnails have a
pixel per luminance block, from its DC coefficient alone.

Defined cases: a null text counts as empty; a media value that is null or no baseline JPEG has null features and payload;
whole texts are stored at any length; equal texts give equal media; an empty table gives an empty table; columns named
like an added one are replaced, all others are carried along.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_values, lean, slices, wider

UNIT, PAD = 576, 0xFF
#: Units of one image: its height stays within the format's 65,535 rows.
IMAGE_UNITS = 2048
SLICE_BYTES = 2_000_000


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _header(blocks: int) -> bytes:
    """Up to the entropy-coded data of an image of 24 pixels a row."""
    counts = bytes([1] + [0] * 15)  # one code, of one bit
    return b"".join([
        b"\xff\xd8",
        _segment(0xDB, bytes([0]) + bytes([1] * 64)),
        _segment(0xC0, struct.pack(">BHHB", 8, 8 * (blocks // 3), 24, 1) + bytes([1, 0x11, 0])),
        _segment(0xC4, bytes([0x00]) + counts + bytes([8])),
        _segment(0xC4, bytes([0x10]) + counts + bytes([8])),
        _segment(0xDD, struct.pack(">H", 1)),
        _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
    ])


def payload(text: bytes) -> bytes:
    return text + bytes([PAD]) * (UNIT - len(text) if not text else -len(text) % UNIT)


def encode(payloads: list[bytes]) -> list[bytes]:
    """A media value for each payload of a positive multiple of UNIT bytes."""
    if not payloads:
        return []
    images = [p[i : i + UNIT * IMAGE_UNITS] for p in payloads for i in range(0, len(p), UNIT * IMAGE_UNITS)]
    per_payload = [-(-len(p) // (UNIT * IMAGE_UNITS)) for p in payloads]
    blocks = np.array([len(x) // 64 for x in images])
    raw = np.frombuffer(b"".join(images), np.uint8).reshape(-1, 64)
    bits = np.zeros((len(raw), 64, 9), np.uint8)  # a code of one bit, then the magnitude bits
    bits[:, :, 1:] = np.unpackbits(raw, axis=1).reshape(-1, 64, 8)
    coded = np.empty((len(raw), 74), np.uint8)
    coded[:, :72] = np.packbits(bits.reshape(len(raw), 576), axis=1)
    last = np.cumsum(blocks) - 1
    coded[:, 72] = 0xFF
    coded[:, 73] = 0xD0 + (np.arange(len(raw)) - np.repeat(last + 1 - blocks, blocks)) % 8
    coded[last, 73] = 0xD9
    stuffed = coded == 0xFF
    stuffed[:, 72:] = False
    size = 74 + stuffed.sum(axis=1)
    flat = stuffed.reshape(-1)
    out = np.repeat(coded.reshape(-1), 1 + flat)
    out[np.flatnonzero(flat) + np.arange(1, flat.sum() + 1)] = 0
    stops = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], last + 1])].tolist()
    whole = out.tobytes()
    done = iter([_header(int(n)) + whole[a:b] for n, a, b in zip(blocks, stops, stops[1:], strict=False)])
    return [b"".join(next(done) for _ in range(n)) for n in per_payload]


@dataclass
class Scan:
    components: list[int]
    tables: list[tuple[int, int]]  # of each component: DC and AC
    interval: int
    segments: list[tuple[int, int]]  # in the buffer
    units: list[int] = field(default_factory=list)  # the component of each block of an MCU
    mcus: int = 0
    first: int = 0  # block in the decoded coefficients


@dataclass
class Image:
    width: int
    height: int
    components: list[tuple[int, int, int, int]]  # id, h, v, quantiser
    quantisers: dict[int, np.ndarray]
    scans: list[Scan]


class Tables:
    """Huffman tables as look-ups over 16 bits, each distinct table once."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}
        self.rows: list[np.ndarray] = []

    def add(self, body: bytes) -> int:
        """body: 16 counts of codes by length, then the symbols. A look-up holds 256 * length + symbol, 0 for no code."""
        if body not in self.known:
            look, code, at = np.zeros(1 << 16, np.int64), 0, 16
            for length in range(1, 17):
                for symbol in body[at : at + body[length - 1]]:
                    look[code << (16 - length) : (code + 1) << (16 - length)] = 256 * length + symbol
                    code += 1
                at += body[length - 1]
                code <<= 1
            self.known[body] = len(self.rows)
            self.rows.append(look)
        return self.known[body]

    def all(self) -> np.ndarray:
        return np.concatenate(self.rows)


def _parse(data: bytes, base: int, tables: Tables) -> list[Image]:
    """The images of a media value; positions are shifted by base. Raises ValueError where it isn't baseline JPEG."""
    images: list[Image] = []
    view = np.frombuffer(data, np.uint8)
    ff = np.flatnonzero(view[:-1] == 0xFF)
    after = view[ff + 1]
    marks = ff[(after != 0) & (after != 0xFF)]
    kinds = view[marks + 1]
    ends = marks[(kinds < 0xD0) | (kinds > 0xD7)]
    at, quantisers, huffman, interval, image = 0, {}, {}, 0, None
    try:
        while at < len(data):
            if data[at] != 0xFF:
                raise ValueError("no marker")
            kind = data[at + 1]
            if kind == 0xD8:
                quantisers, huffman, interval, image = {}, {}, 0, None
                at += 2
                continue
            if kind == 0xD9:
                if image is None or not image.scans:
                    raise ValueError("an image without a scan")
                images.append(image)
                image = None
                at += 2
                continue
            if kind == 0xFF:
                at += 1
                continue
            length = struct.unpack_from(">H", data, at + 2)[0]
            body, at = data[at + 4 : at + 2 + length], at + 2 + length
            if kind == 0xDB:
                while body:
                    wide, n = body[0] >> 4, body[0] & 15
                    quantisers[n] = np.frombuffer(body[1:], ">u2" if wide else np.uint8, 64).astype(np.int64)
                    body = body[65 + 64 * bool(wide) :]
            elif kind == 0xC4:
                while body:
                    n = 17 + sum(body[1:17])
                    huffman[body[0]] = tables.add(bytes(body[1:n]))
                    body = body[n:]
            elif kind == 0xDD:
                interval = struct.unpack(">H", body)[0]
            elif kind == 0xC0:
                bits, height, width, n = struct.unpack_from(">BHHB", body)
                if bits != 8 or not height or not width:
                    raise ValueError("not an 8-bit image of known size")
                parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
                image = Image(width, height, parts, quantisers, [])
            elif 0xC0 < kind <= 0xCF and kind != 0xCC:
                raise ValueError("not baseline")
            elif kind == 0xDA:
                n = body[0]
                ids = [c[0] for c in image.components]
                chosen = [ids.index(body[1 + 2 * i]) for i in range(n)]
                picked = [(huffman[body[2 + 2 * i] >> 4], huffman[0x10 | body[2 + 2 * i] & 15]) for i in range(n)]
                stop = int(ends[np.searchsorted(ends, at)]) if len(ends) and ends[-1] >= at else len(data)
                inside = marks[np.searchsorted(marks, at) : np.searchsorted(marks, stop)].tolist()
                segments = [(base + a, base + b) for a, b in zip([at, *[x + 2 for x in inside]], [*inside, stop], strict=True)]
                scan = Scan(chosen, picked, interval, segments)
                _layout(image, scan)
                image.scans.append(scan)
                at = stop
    except (IndexError, KeyError, struct.error, AttributeError) as e:
        raise ValueError("broken") from e
    if image is not None or not images:
        raise ValueError("no end of an image")
    return images


def _grid(image: Image, component: int) -> tuple[int, int]:
    """Blocks across and down that a component has for itself."""
    wide, tall = max(c[1] for c in image.components), max(c[2] for c in image.components)
    _, h, v, _ = image.components[component]
    return -(-(-(-image.width * h // wide)) // 8), -(-(-(-image.height * v // tall)) // 8)


def _layout(image: Image, scan: Scan) -> None:
    if len(scan.components) == 1:
        across, down = _grid(image, scan.components[0])
        scan.units, scan.mcus = [0], across * down
    else:
        wide, tall = max(c[1] for c in image.components), max(c[2] for c in image.components)
        scan.units = [i for i, c in enumerate(scan.components) for _ in range(image.components[c][1] * image.components[c][2])]
        scan.mcus = -(-image.width // (8 * wide)) * -(-image.height // (8 * tall))
    if len(scan.segments) != (-(-scan.mcus // scan.interval) if scan.interval else 1):
        raise ValueError("restart markers don't fit the size")


def _decode(data: np.ndarray, scans: list[Scan], tables: Tables) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients in scan order, a row per block in order of the scans, and which of the scans are whole."""
    blocks = 0
    for scan in scans:
        scan.first = blocks
        blocks += scan.mcus * len(scan.units)
    coefficients = np.zeros(blocks * 64, np.int16)
    # A lane is a restart interval.
    begin = np.array([a for s in scans for a, _ in s.segments], np.int64)
    end = np.array([b for s in scans for _, b in s.segments], np.int64)
    owner = np.repeat(np.arange(len(scans)), [len(s.segments) for s in scans])
    nth = np.concatenate([np.arange(len(s.segments)) for s in scans])
    units = np.array([len(s.units) for s in scans])
    interval = np.array([s.interval or s.mcus for s in scans])
    mcus = np.array([s.mcus for s in scans])
    block = np.array([s.first for s in scans])[owner] + nth * (interval * units)[owner]
    left = np.minimum(interval[owner], mcus[owner] - nth * interval[owner]) * units[owner]
    # Without the zeros that are stuffed behind 0xFF.
    stuffed = np.zeros(len(data), bool)
    stuffed[1:] = (data[:-1] == 0xFF) & (data[1:] == 0)
    removed = np.cumsum(stuffed)
    plain = np.concatenate([data[~stuffed], np.zeros(8, np.uint8)]).astype(np.uint64)
    shift = np.concatenate([[0], removed])
    begin, end = (begin - shift[begin]) * 8, (end - shift[end]) * 8
    words = plain[:-4] << np.uint64(32) | plain[1:-3] << np.uint64(24) | plain[2:-2] << np.uint64(16) | plain[3:-1] << np.uint64(8) | plain[4:]
    words = words.view(np.int64)
    # Table, by scan and unit of its MCU, of DC and AC; of what a unit's DC is predicted from.
    most = int(units.max())
    dc, ac, part = (np.zeros((len(scans), most), np.int64) for _ in range(3))
    for i, s in enumerate(scans):
        dc[i, : len(s.units)] = [s.tables[u][0] << 16 for u in s.units]
        ac[i, : len(s.units)] = [s.tables[u][1] << 16 for u in s.units]
        part[i, : len(s.units)] = s.units
    look = tables.all()
    simple = most == 1
    lane = np.arange(len(begin))
    pos, k, unit = begin.copy(), np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
    predicted = np.zeros((len(begin), int(part.max()) + 1), np.int64)
    own, good = owner, np.ones(len(scans), bool)
    dc_now, ac_now = dc[own, 0], ac[own, 0]
    while len(lane):
        at_dc = k == 0
        word = words[np.minimum(pos >> 3, len(words) - 1)] << (pos & 7) & 0xFFFFFFFFFF
        found = look[np.where(at_dc, dc_now, ac_now) + (word >> 24)]
        length, symbol = found >> 8, found & 255
        size = np.where(at_dc, np.minimum(symbol, 15), symbol & 15)
        run = np.where(at_dc, 0, symbol >> 4)
        bits = word >> (40 - length - size) & (1 << size) - 1
        value = np.where(bits >> np.maximum(size - 1, 0) > 0, bits, bits - (1 << size) + 1)
        pos = pos + length + size
        if at_dc.any():
            p = part[own, unit]
            rows = np.flatnonzero(at_dc)
            predicted[rows, p[rows]] += value[rows]
            value = np.where(at_dc, predicted[np.arange(len(lane)), p], value)
        k = k + run
        write = (at_dc | (size > 0)) & (k < 64)
        if write.all():
            coefficients[block * 64 + k] = value
        else:
            w = np.flatnonzero(write)
            coefficients[block[w] * 64 + k[w]] = value[w]
        ended = ~at_dc & (size == 0) & (run < 15)
        k = np.where(ended, 64, k + 1)
        bad = (length == 0) | (pos > end) | (k > 64)
        over = k >= 64
        if over.any() or bad.any():
            if bad.any():
                good[own[bad]] = False
            block, left = block + over, left - over
            k = np.where(over, 0, k)
            if not simple:
                unit = np.where(over, (unit + 1) % units[own], unit)
                dc_now, ac_now = dc[own, unit], ac[own, unit]
            go = (left > 0) & ~bad
            if not go.all():
                lane, pos, k, unit, block, left, own, end, predicted, dc_now, ac_now = (x[go] for x in (lane, pos, k, unit, block, left, own, end, predicted, dc_now, ac_now))
    return coefficients.reshape(-1, 64), good


def _luminance(image: Image, coefficients: np.ndarray) -> np.ndarray | None:
    """Coefficients of the first component, by row and column of its blocks."""
    for scan in image.scans:
        if 0 not in scan.components:
            continue
        across, down = _grid(image, 0)
        mine = coefficients[scan.first : scan.first + scan.mcus * len(scan.units)]
        if len(scan.components) == 1:
            return mine.reshape(down, across, 64)
        _, h, v, _ = image.components[0]
        unit = scan.components.index(0)
        wide = -(-image.width // (8 * max(c[1] for c in image.components)))
        mine = mine.reshape(-1, wide, len(scan.units), 64)[:, :, [i for i, u in enumerate(scan.units) if u == unit]]
        mine = mine.reshape(-1, wide, v, h, 64).transpose(0, 2, 1, 3, 4).reshape(-1, wide * h, 64)
        return mine[:down, :across]
    return None


def thumbnail(image: Image, luminance: np.ndarray) -> np.ndarray:
    """A pixel per block: its mean, which is the dequantised DC coefficient over 8, around 128."""
    dc = luminance[:, :, 0].astype(np.int64) * int(image.quantisers[image.components[0][3]][0])
    return np.clip((dc + 4 >> 3) + 128, 0, 255).astype(np.uint8)


def _areas(pixels: np.ndarray) -> np.ndarray:
    """Means of 8 areas along the first axis, which cover all of it; areas of fewer than 8 rows share rows."""
    n = len(pixels)
    at = np.arange(8)
    begin = at * n // 8
    end = np.maximum(-(-(at + 1) * n // 8), begin + 1)
    sums = np.concatenate([np.zeros((1, pixels.shape[1])), np.cumsum(pixels, axis=0, dtype=np.float64)])
    return (sums[end] - sums[begin]) / (end - begin)[:, None]


def mean_hash(pictures: list[np.ndarray]) -> str:
    """16 hex digits: which of 8x8 areas are above their mean; pictures stand one below the other, each over the full width."""
    small = _areas(np.concatenate([_areas(x.T).T for x in pictures]))
    return np.packbits(small > small.mean()).tobytes().hex()


def decode(values: list[bytes | None]) -> list[tuple | None]:
    """(width, height, images, thumbnail, mean hash, payload) of each media value.

    Images of a value stand one below the other: its width is that of the widest, its height the sum of all.
    """
    tables, parsed, base = Tables(), [], 0
    for value in values:
        try:
            parsed.append(_parse(value, base, tables) if value else None)
        except ValueError:
            parsed.append(None)
        base += len(value or b"")
    scans = [s for images in parsed if images for image in images for s in image.scans]
    if not scans:
        return [None] * len(values)
    coefficients, good = _decode(np.frombuffer(b"".join(x or b"" for x in values), np.uint8), scans, tables)
    broken = {id(s) for s, ok in zip(scans, good, strict=True) if not ok}
    out: list[tuple | None] = []
    for images in parsed:
        if images is None or any(id(s) in broken for image in images for s in image.scans):
            out.append(None)
            continue
        parts = [_luminance(image, coefficients) for image in images]
        if any(p is None for p in parts):
            out.append(None)
            continue
        pixels = [thumbnail(i, p) for i, p in zip(images, parts, strict=True)]
        # The magnitude bits of a coefficient of eight bits are its byte.
        stored = b"".join(np.where(p < 0, p + 255, p).astype(np.uint8).tobytes() for p in parts)
        out.append((max(i.width for i in images), sum(i.height for i in images), len(images), b"".join(x.tobytes() for x in pixels), mean_hash(pixels), stored))
    return out


def store(docs: DataFrame) -> DataFrame:
    """Replaces the text by n_bytes and media."""
    kept = [c for c in docs.columns if c not in ("text", "n_bytes", "media")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            texts = byte_values(batch.column("text"))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(map(len, texts), pa.int64()), pa.array(encode([payload(t) for t in texts]), pa.binary())], [*kept, "n_bytes", "media"])

    return docs.select(*kept, "text").mapInArrow(lean(run), wider(docs.select(*kept), "n_bytes long, media binary"))


ADDED = "width int, height int, images int, thumbnail binary, thumbnail_hash string, mean_hash string, payload binary"


def read(media: DataFrame) -> DataFrame:
    """Adds what is decoded from the media column: sizes, thumbnail and its hashes, payload."""
    names = [x.split()[0] for x in ADDED.split(", ")]
    kept = [c for c in media.columns if c not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media", SLICE_BYTES):
            rows = [r or (None,) * 6 for r in decode(batch.column("media").to_pylist())]
            w, h, n, pixels, mean, stored = zip(*rows, strict=True)
            marks = [None if x is None else f"{xxhash.xxh64_intdigest(x):016x}" for x in pixels]
            made = [pa.array(w, pa.int32()), pa.array(h, pa.int32()), pa.array(n, pa.int32()), pa.array(pixels, pa.binary()), pa.array(marks, pa.string()), pa.array(mean, pa.string()), pa.array(stored, pa.binary())]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *made], [*kept, *names])

    return media.select(*kept).mapInArrow(lean(run), wider(media.select(*kept), ADDED))


def digests(read_back: DataFrame) -> DataFrame:
    """The columns that describe a stored payload, from what was read back."""
    return read_back.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.concat_ws("x", "width", "height"), F.col("images").cast("string"), "thumbnail_hash", "mean_hash").alias("feature"),
    )
