"""GIF media columns: encode, decode, and colour features.

A byte string becomes a GIF of 8-bit samples under a grey palette: frames of 24
columns and up to 16 times 24 rows, each with its delay. The decoder reads any GIF: LZW code streams
with clear codes and growing code widths, global and local palettes,
interlacing, frames smaller than the screen, transparency, and the disposal
rules (leave, clear to the background, restore what was there). Frames come out
as composed pictures with their time, and a colour histogram each.

Code widths depend only on how many codes have come since the last clear code,
so the bits of a whole run of codes are cut apart or put together at once; only
the dictionary itself is followed code by code.

Defined results: null text counts as empty, whose payload is one frame of 255s.
Equal texts give equal bytes. A truncated or corrupt stream raises
``ValueError``; in a table of media it gives the frames before the fault and one
row with the error. Null media have no frames.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiverine.llm.common import STEP_BYTES, read, steps, without_gc

SIDE = 24
TILE = SIDE * SIDE
#: Tiles of a frame: longer streams compress better, and their codes outgrow the dictionary little.
TILES = 16
#: Hundredths of a second that a frame is shown.
DELAY = 4
MOST_CODES = 4096
LEAVE, BACKGROUND, RESTORE = 1, 2, 3
GREY = bytes(v for v in range(256) for _ in range(3))


class _Widths:
    """Widths, and bit offsets, of the codes after a clear code, for one minimal code size."""

    def __init__(self, least: int) -> None:
        n = MOST_CODES + 2
        known = (1 << least) + 2 + np.maximum(np.arange(n) - 1, 0)
        self.of = np.minimum(np.floor(np.log2(known)).astype(np.int64) + 1, 12)
        self.offsets = np.concatenate([[0], np.cumsum(self.of)])
        self.masks = (1 << self.of) - 1


_WIDTHS = {least: _Widths(least) for least in range(2, 9)}


def lzw_encode(data: bytes, least: int = 8) -> bytes:
    """The code stream of ``data``, whose samples are below ``1 << least``."""
    clear = 1 << least
    end = clear + 1
    segments: list[list[int]] = []
    codes: list[int] = []
    table: dict[int, int] = {}
    get, nxt, prefix = table.get, clear + 2, -1
    for b in data:
        if prefix < 0:
            prefix = b
            continue
        key = prefix << 8 | b
        code = get(key)
        if code is not None:
            prefix = code
            continue
        codes.append(prefix)
        prefix = b
        if nxt < MOST_CODES:
            table[key] = nxt
            nxt += 1
        else:
            codes.append(clear)
            segments.append(codes)
            codes, nxt = [], clear + 2
            table.clear()
    if prefix >= 0:
        codes.append(prefix)
    codes.append(end)
    segments.append(codes)
    widths = _WIDTHS[least]
    bits = [np.array([(clear >> k) & 1 for k in range(least + 1)], np.uint8)]
    for own in segments:
        n = len(own)
        matrix = np.unpackbits(np.array(own, "<u2").view(np.uint8).reshape(n, 2), axis=1, bitorder="little")
        bits.append(matrix[np.arange(16) < widths.of[:n, None]])
    return np.packbits(np.concatenate(bits), bitorder="little").tobytes()


def lzw_decode(stream: bytes, least: int, most: int) -> bytes:
    """The samples of a code stream, ``most`` at most."""
    clear = 1 << least
    end = clear + 1
    widths = _WIDTHS[least]
    padded = np.frombuffer(stream + b"\0\0\0\0", np.uint8).astype(np.int64)
    total = len(stream) * 8
    at = 0
    if int.from_bytes(stream[:2], "little") & ((2 << least) - 1) == clear:
        at = least + 1  # the clear code that a stream begins with
    out: list[bytes] = []
    base = [bytes([k]) for k in range(clear)] + [b"", b""]
    while True:
        n = int(np.searchsorted(widths.offsets, min(total - at, int(widths.offsets[-1])), side="right")) - 1
        if n < 1:
            break
        offsets = at + widths.offsets[:n]
        first = offsets >> 3
        window = padded[first] | padded[first + 1] << 8 | padded[first + 2] << 16
        codes = (window >> (offsets & 7)) & widths.masks[:n]
        stops = np.flatnonzero((codes == clear) | (codes == end))
        if len(stops):
            stop = int(stops[0])
            ended = codes[stop] == end
            at = int(offsets[stop] + widths.of[stop])
        elif n == len(widths.of):
            # The table is full and goes on being used: codes of 12 bits until one that stops.
            known = b"".join(out)
            return known + _decode_slowly(padded, at, total, least, most - len(known))
        else:
            stop, ended = n, True  # no end code: what there is
        if stop:
            table = base.copy()
            add, put = table.append, out.append
            row = codes[:stop].tolist()
            if row[0] >= clear:
                raise ValueError("a code stream begins with an unknown code")
            last = table[row[0]]
            put(last)
            for code in row[1:]:
                try:
                    entry = table[code]
                    add(last + entry[:1])
                except IndexError:
                    if code != len(table):
                        raise ValueError("a code stream holds an unknown code") from None
                    entry = last + last[:1]
                    add(entry)
                put(entry)
                last = entry
        if ended or len(out) >= most:
            break
    return b"".join(out)[:most]


def _decode_slowly(padded: np.ndarray, at: int, total: int, least: int, most: int) -> bytes:
    """Code by code, with a table that may stay full: what few encoders write."""
    clear = 1 << least
    end, out, last, size, width = clear + 1, [], b"", 0, least + 1
    base = [bytes([k]) for k in range(clear)] + [b"", b""]
    table = base.copy()
    data = padded.astype(np.uint8).tobytes()
    while size < most:
        if at + width > total:
            break
        code = int.from_bytes(data[at >> 3 : (at >> 3) + 3], "little") >> (at & 7) & ((1 << width) - 1)
        at += width
        if code == end:
            break
        if code == clear:
            table, last, width = base.copy(), b"", least + 1
            continue
        if code < len(table):
            entry = table[code]
        elif code == len(table) and last:
            entry = last + last[:1]
        else:
            raise ValueError("a code stream holds an unknown code")
        if last and len(table) < MOST_CODES:
            table.append(last + entry[:1])
            if len(table) == 1 << width and width < 12:
                width += 1
        out.append(entry)
        size += len(entry)
        last = entry
    return b"".join(out)[:most]


def _blocks(data: bytes) -> bytes:
    """Data as sub-blocks of up to 255 bytes, with the empty one at the end."""
    return b"".join(bytes([len(part)]) + part for part in (data[a : a + 255] for a in range(0, len(data), 255))) + b"\0"


def encode(payload: bytes, delay: int = DELAY) -> bytes:
    """A GIF whose frames' samples are ``payload``, a multiple of 576 bytes."""
    if not payload or len(payload) % TILE:
        raise ValueError(f"a payload is a positive multiple of {TILE} bytes")
    control = b"\x21\xf9\x04" + struct.pack("<BHBB", LEAVE << 2, delay, 0, 0)
    most = TILE * TILES
    out = [b"GIF89a", struct.pack("<HHBBB", SIDE, min(most, len(payload)) // SIDE, 0xF7, 0, 0), GREY, b"\x21\xff\x0bNETSCAPE2.0\x03\x01\0\0\0"]
    for a in range(0, len(payload), most):
        own = payload[a : a + most]
        out += [control, b"\x2c" + struct.pack("<HHHHB", 0, 0, SIDE, len(own) // SIDE, 0) + b"\x08", _blocks(lzw_encode(own))]
    return b"".join([*out, b"\x3b"])


@dataclass
class Frame:
    """A composed picture: its start and length in hundredths of a second, its pixels (height, width, RGBA), and which of them the frame drew."""

    start: int
    delay: int
    pixels: np.ndarray
    drawn: np.ndarray


def _read_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    out = []
    while True:
        if at >= len(data):
            raise ValueError("the file ends within a block")
        n = data[at]
        if not n:
            return b"".join(out), at + 1
        out.append(data[at + 1 : at + 1 + n])
        at += n + 1


def decode(data: bytes) -> Iterator[Frame]:
    """The frames of any GIF, composed on its screen."""
    try:
        yield from _decode(data)
    except (IndexError, struct.error) as error:
        raise ValueError("the file ends early") from error


def _decode(data: bytes) -> Iterator[Frame]:
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("not a GIF")
    width, height, flags = struct.unpack("<HHB", data[6:11])
    at, shared = 13, None
    if flags & 0x80:
        n = 2 << (flags & 7)
        shared = _palette(data[at : at + 3 * n])
        at += 3 * n
    screen = np.zeros((height, width, 4), np.uint8)
    disposal, delay, transparent, start = 0, 0, -1, 0
    while True:
        mark = data[at : at + 1]
        if mark == b"\x3b":
            return
        if mark == b"\x21":
            label = data[at + 1]
            body, at = _read_blocks(data, at + 2)
            if label == 0xF9 and len(body) >= 4:
                disposal, delay = (body[0] >> 2) & 7, body[1] | body[2] << 8
                transparent = body[3] if body[0] & 1 else -1
            continue
        if mark != b"\x2c" or at + 10 > len(data):
            raise ValueError("an unknown block, or an early end")
        x, y, w, h, own = struct.unpack("<HHHHB", data[at + 1 : at + 10])
        at += 10
        palette = shared
        if own & 0x80:
            n = 2 << (own & 7)
            palette = _palette(data[at : at + 3 * n])
            at += 3 * n
        if palette is None:
            raise ValueError("a frame without a palette")
        least = data[at]
        if not 2 <= least <= 8:
            raise ValueError("an unknown code size")
        body, at = _read_blocks(data, at + 1)
        samples = np.frombuffer(lzw_decode(body, least, w * h), np.uint8)
        if len(samples) != w * h:
            raise ValueError("a frame lacks samples")
        samples = samples.reshape(h, w)
        if own & 0x40:
            samples = samples[np.argsort(np.concatenate([np.arange(a, h, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))]), kind="stable")]
        before = screen.copy() if disposal == RESTORE else None
        area = screen[y : y + h, x : x + w]
        colours = palette[samples][: area.shape[0], : area.shape[1]]
        if transparent >= 0:
            shown = (samples != transparent)[: area.shape[0], : area.shape[1]]
            area[shown] = colours[shown]
        else:
            area[...] = colours
        shot = screen.copy()
        yield Frame(start, delay, shot, shot[y : y + h, x : x + w])
        start += delay
        if disposal == BACKGROUND:
            area[...] = 0
        elif before is not None:
            screen = before
        disposal, delay, transparent = 0, 0, -1


def _palette(data: bytes) -> np.ndarray:
    colours = np.frombuffer(data, np.uint8).reshape(-1, 3)
    out = np.zeros((256, 4), np.uint8)
    out[: len(colours), :3] = colours
    out[: len(colours), 3] = 255
    return out


#: Bins of a colour channel in a frame's histogram.
BINS = 8


def histogram(pixels: np.ndarray) -> np.ndarray:
    """Counts of the pixels' red, green and blue in ``BINS`` bins each; transparent pixels are left out."""
    shown = pixels.reshape(-1, 4)
    if not shown[:, 3].all():
        shown = shown[shown[:, 3] > 0]
    if np.array_equal(shown[:, 0], shown[:, 1]) and np.array_equal(shown[:, 0], shown[:, 2]):
        return np.tile(np.bincount(shown[:, 0] >> 5, minlength=BINS), 3)
    return np.concatenate([np.bincount(shown[:, c] >> 5, minlength=BINS) for c in range(3)])


def payload_of(text: str | None) -> tuple[int, bytes]:
    """The bytes of a text, padded with 255 to whole frames, and their number before."""
    own = (text or "").encode()
    return len(own), own + b"\xff" * (max(1, -(-len(own) // TILE)) * TILE - len(own))


def describe(text: str | None) -> tuple:
    """Store a text's payload, read it back, and describe what was read."""
    n, payload = payload_of(text)
    media = encode(payload)
    digest, tail, size, frames, time = hashlib.sha256(), b"", 0, 0, 0
    total, spread = np.zeros(3 * BINS, np.int64), 0
    last = None
    for frame in decode(media):
        samples = frame.drawn[:, :, 0].tobytes()
        digest.update(samples)
        tail, size, frames, time = samples[-32:], size + len(samples), frames + 1, frame.start + frame.delay
        own = histogram(frame.drawn)
        total += own
        if last is not None:
            spread += int(np.abs(own - last).sum())
        last = own
    feature = f"frames={frames};time={time};change={spread};grey=" + ",".join(map(str, total[:BINS]))
    return n, size, digest.hexdigest(), zlib.crc32(tail), len(media), hashlib.sha256(media).hexdigest(), feature


_FIELDS = (("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()))


def media_digests(docs: DataFrame) -> DataFrame:
    """doc_id and the description of the stored payload of every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with without_gc():
            for batch in steps(batches):
                yield described(batch)

    def described(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [describe(t) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(_FIELDS))], ["doc_id", *(name for name, _ in _FIELDS)])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def store(docs: DataFrame) -> DataFrame:
    """doc_id and a binary column ``media`` with the GIF of every row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([encode(payload_of(t)[1]) for t in batch.column(1).to_pylist()], pa.binary())], ["doc_id", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, media binary")


_FRAME = ("frame", "start", "delay", "width", "height", "pixels", "histogram", "error")


def frames(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """One row per frame of a table of GIFs: key, frame, start, delay, width, height, RGBA pixels, the histogram, and error.

    A file that can't be read to its end has, after its whole frames, a row of
    which only key, frame and error are set. ``key`` may not be the name of
    another of these columns.
    """
    if key in _FRAME:
        raise ValueError(f"the key can't be called {key}")
    kind = media.schema[key].dataType.simpleString()
    out_kind = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            for at in range(batch.num_rows):
                data = batch.column(1)[at].as_py()
                if data is None:
                    continue
                rows: list[tuple] = []
                done = 0
                try:
                    for f in decode(data):
                        rows.append((len(rows) + done, f.start, f.delay, f.pixels.shape[1], f.pixels.shape[0], f.pixels.tobytes(), histogram(f.pixels).tolist(), None))
                        if f.pixels.nbytes * len(rows) > STEP_BYTES:  # long animations in several batches
                            yield framed(batch, at, rows)
                            rows, done = [], done + len(rows)
                except ValueError as error:
                    rows.append((len(rows) + done, *[None] * 6, str(error)))
                if rows:
                    yield framed(batch, at, rows)

    def framed(batch: pa.RecordBatch, at: int, rows: list[tuple]) -> pa.RecordBatch:
        own = pa.array([batch.column(0)[at].as_py()] * len(rows), batch.column(0).type)
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), out_kind, pa.string())
        return pa.RecordBatch.from_arrays([own, *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], ["key", *_FRAME])

    found = media.select(F.col(f"`{key}`").alias("key"), F.col(f"`{column}`").alias("media")).mapInArrow(run, f"key {kind}, frame int, start int, delay int, width int, height int, pixels binary, histogram array<long>, error string")
    return found.toDF(key, *_FRAME)


def op6_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract over every whole text of ``documents``."""
    return media_digests(read(spark, sf_dir, "documents"))
