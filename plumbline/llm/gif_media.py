"""GIF media columns: frames with times and colour histograms, and a lossless container.

Reading follows the format: colour tables, interlaced rows, transparency, disposal of frames
and LZW code streams. Code widths depend only on how many codes came since the last clear, so
the bits of a whole run of codes are cut out at once, and all of them are looked up together.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from plumbline.llm.common import carried, sliced, text_of
from plumbline.llm.common import column as column_of

WIDTH, FRAME_ROWS, DELAY = 192, 64, 4
MOST_CODES = 4096
GREY = bytes(v for k in range(256) for v in (k, k, k))


@dataclass
class Frame:
    """One shown picture: RGBA canvas, hundredths of a second it stays, and its own palette indices."""

    canvas: np.ndarray
    delay: int
    disposal: int
    indices: np.ndarray


def _widths(min_bits: int) -> np.ndarray:
    """Bits of the first, second, ... code after a clear, until the dictionary is full."""
    clear = 1 << min_bits
    # When code k is read, clear + 2 + (k - 1) entries exist (no new one for the first).
    entries = np.maximum(np.arange(MOST_CODES - clear) - 1, 0) + clear + 2
    return np.minimum(np.floor(np.log2(entries)).astype(np.int64) + 1, 12)


_SCHEDULES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _schedule(min_bits: int) -> tuple[np.ndarray, np.ndarray]:
    if min_bits not in _SCHEDULES:
        width = _widths(min_bits)
        _SCHEDULES[min_bits] = width, np.cumsum(width) - width
    return _SCHEDULES[min_bits]


def _cut_codes(data: np.ndarray, start: int, widths: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Codes of the given widths from bit ``start`` on, as many as the data hold."""
    n = int(np.searchsorted(offsets + widths, (len(data) - 4) * 8 - start, side="right"))
    at = start + offsets[:n]
    byte = at >> 3
    window = data[byte].astype(np.int64) | data[byte + 1].astype(np.int64) << 8 | data[byte + 2].astype(np.int64) << 16
    return window >> (at & 7) & ((1 << widths[:n]) - 1)


def _expanded(codes: np.ndarray, clear: int) -> np.ndarray:
    """The indices that the codes after a clear stand for.

    Entry k is the string of code k and the first index of code k + 1, so a code of entry p is a
    chain of links from p to the code there, down to a plain index. All chains are followed at
    once, a link at a time: each gives one index from the end of its string.
    """
    plain = codes < clear
    link = codes - (clear + 2)
    if (~plain & ((link < 0) | (link >= np.arange(len(codes))))).any():
        raise ValueError("a code that is not in the dictionary")
    first, length, steps = codes.copy(), np.ones(len(codes), dtype=np.int64), []
    going = np.flatnonzero(~plain)
    at = link[going]
    while len(going):
        length[going] += 1
        steps.append((going, at))
        ended = plain[at]
        first[going[ended]] = codes[at[ended]]
        going, at = going[~ended], link[at[~ended]]
    ends = np.cumsum(length)
    out = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
    out[ends - length] = first
    for back, (going, at) in enumerate(steps, 1):
        out[ends[going] - back] = first[at + 1]
    return out


def lzw_decode(stream: bytes, min_bits: int, most: int | None = None) -> bytes:
    """The indices of an LZW stream. Ends at the end code, at ``most`` indices or with the data; a code that cannot occur raises ValueError."""
    clear, stop = 1 << min_bits, (1 << min_bits) + 1
    data = np.frombuffer(stream + b"\0\0\0\0", dtype=np.uint8)
    growing = _schedule(min_bits)
    # A full dictionary: 12 bits a code, nothing new, until a clear.
    full = np.full(MOST_CODES, 12), np.arange(MOST_CODES) * 12
    out: list[np.ndarray] = []
    run: list[np.ndarray] = []
    made = bit = 0
    while True:
        widths, offsets = full if run else growing
        codes = _cut_codes(data, bit, widths, offsets)
        ends = np.flatnonzero((codes == clear) | (codes == stop))
        n = int(ends[0]) if len(ends) else len(codes)
        run.append(codes[:n])
        if not len(ends) and n == len(widths):
            bit += int(offsets[-1] + widths[-1])
            continue
        out.append(_expanded(np.concatenate(run), clear))
        made += len(out[-1])
        run = []
        if not len(ends) or int(codes[n]) == stop or most is not None and made >= most:
            break
        bit += int(offsets[n] + widths[n])
    return np.concatenate(out).tobytes()[:most]


def lzw_encode(indices: bytes, min_bits: int = 8) -> bytes:
    """An LZW stream; the dictionary is cleared when it is full."""
    clear = 1 << min_bits
    codes = [clear]
    runs: list[int] = []
    table: dict[int, int] = {}
    find, emit, new = table.get, codes.append, clear + 2
    mark = 1
    if indices:
        prefix = indices[0]
        for value in indices[1:]:
            code = find(prefix << 8 | value)
            if code is not None:
                prefix = code
                continue
            emit(prefix)
            if new < MOST_CODES - 1:
                table[prefix << 8 | value] = new
                new += 1
            else:
                emit(clear)
                runs.append(len(codes) - mark)
                mark, new = len(codes), clear + 2
                table.clear()
            prefix = value
        emit(prefix)
    emit(clear + 1)
    runs.append(len(codes) - mark)
    schedule = _schedule(min_bits)[0]
    widths = np.concatenate([[min_bits + 1], *(schedule[:n] for n in runs)])
    bits = np.unpackbits(np.array(codes, dtype="<u2").view(np.uint8).reshape(-1, 2), axis=1, bitorder="little")
    return np.packbits(bits[np.arange(16) < widths[:, None]], bitorder="little").tobytes()


def _sub_blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(p := data[i : i + 255])]) + p for i in range(0, len(data), 255)) + b"\0"


def _read_sub_blocks(raw: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while raw[at]:
        parts.append(raw[at + 1 : at + 1 + raw[at]])
        at += 1 + raw[at]
    return b"".join(parts), at + 1


def frames_of(raw: bytes) -> Iterator[Frame]:
    """The frames as shown, one after the other. Raises ValueError for what is not a GIF or is cut off."""
    try:
        yield from _decode(raw)
    except (IndexError, struct.error) as e:
        raise ValueError("the file is cut off") from e


def decode_gif(raw: bytes) -> list[Frame]:
    """All frames of a file."""
    return list(frames_of(raw))


def _decode(raw: bytes) -> Iterator[Frame]:
    if raw[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", raw, 6)
    at, shared = 13, None
    if flags & 128:
        size = 3 << (flags & 7) + 1
        shared, at = np.frombuffer(raw, dtype=np.uint8, count=size, offset=at).reshape(-1, 3), at + size
    canvas = np.zeros((height, width, 4), dtype=np.uint8)
    delay = disposal = 0
    clear_index = None
    while raw[at] != 0x3B:
        if raw[at] == 0x21:
            kind = raw[at + 1]
            body, end = _read_sub_blocks(raw, at + 2)
            if kind == 0xF9:
                packed, delay, index = struct.unpack_from("<BHB", body)
                disposal, clear_index = packed >> 2 & 7, index if packed & 1 else None
            at = end
            continue
        if raw[at] != 0x2C:
            raise ValueError("an unknown block")
        left, top, w, h, flags = struct.unpack_from("<HHHHB", raw, at + 1)
        at, palette = at + 10, shared
        if flags & 128:
            size = 3 << (flags & 7) + 1
            palette, at = np.frombuffer(raw, dtype=np.uint8, count=size, offset=at).reshape(-1, 3), at + size
        min_bits = raw[at]
        stream, at = _read_sub_blocks(raw, at + 1)
        found = lzw_decode(stream, min_bits, w * h)
        if len(found) < w * h:
            raise ValueError("a frame is cut off")
        indices = np.frombuffer(found, dtype=np.uint8).reshape(h, w)
        if flags & 64:
            order = [*range(0, h, 8), *range(4, h, 8), *range(2, h, 4), *range(1, h, 2)]
            straight = np.empty_like(indices)
            straight[order] = indices
            indices = straight
        if palette is None:
            raise ValueError("a frame without colours")
        before = canvas.copy() if disposal == 3 else None
        part = canvas[top : top + h, left : left + w]
        seen = indices[: part.shape[0], : part.shape[1]]
        colours = np.zeros((256, 4), dtype=np.uint8)
        colours[: len(palette), :3], colours[: len(palette), 3] = palette, 255
        shown = colours[seen]
        if clear_index is not None:
            shown = np.where((seen == clear_index)[..., None], part, shown)
        part[:] = shown
        yield Frame(canvas.copy(), delay, disposal, indices)
        if disposal == 2:
            part[:] = 0
        elif before is not None:
            canvas = before
        delay = disposal = 0
        clear_index = None


def histogram(canvas: np.ndarray) -> list[int]:
    """Pixels in each of 4 x 4 x 4 cells of red, green and blue; transparent ones do not count."""
    red, green, blue, alpha = (canvas[..., k] for k in range(4))
    cells = (red >> 6 << 4) | (green >> 6 << 2) | (blue >> 6)
    return np.bincount(cells.ravel() if alpha.all() else cells[alpha > 0], minlength=64).tolist()


def store_bytes(payload: bytes) -> bytes:
    """A GIF whose frames hold the payload as grey levels, WIDTH to a row; its length must be a positive multiple of WIDTH."""
    rows = len(payload) // WIDTH
    height = min(rows, FRAME_ROWS)
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, height, 0xF7, 0, 0), GREY]
    for start in range(0, rows, FRAME_ROWS):
        part = payload[start * WIDTH : (start + FRAME_ROWS) * WIDTH]
        out += [b"\x21\xf9\x04", struct.pack("<BHB", 1 << 2, DELAY, 0), b"\0", b"\x2c", struct.pack("<HHHHB", 0, 0, WIDTH, len(part) // WIDTH, 0), b"\x08", _sub_blocks(lzw_encode(part))]
    return b"".join([*out, b"\x3b"])


def payload_of(text: str) -> tuple[bytes, int]:
    """UTF-8 bytes filled with spaces to a positive multiple of WIDTH, and their number before."""
    raw = text.encode("utf-8", "replace")
    return raw + b" " * (-len(raw) % WIDTH or (0 if raw else WIDTH)), len(raw)


@dataclass
class Reading:
    """What is kept of a file while its frames pass, so that only one of them is held."""

    n_bytes: int = 0
    tail: bytes = b""
    frames: int = 0
    hundredths: int = 0
    counts: np.ndarray | None = None
    digest: str = ""

    @property
    def feature(self) -> str:
        """frames:hundredths:histogram over all frames, its 64 counts joined by commas without the zero counts at the end."""
        counts = np.zeros(64, dtype=int) if self.counts is None else self.counts
        return f"{self.frames}:{self.hundredths}:{','.join(map(str, np.trim_zeros(counts, 'b').tolist()))}"


def read_back(frames: Iterable[Frame]) -> Reading:
    """The stored bytes, which are the red channel of each frame's own rows, with times and colours."""
    out, digest = Reading(counts=np.zeros(64, dtype=np.int64)), hashlib.sha256()
    for f in frames:
        own = f.canvas[: f.indices.shape[0]]
        part = own[..., 0].tobytes()
        digest.update(part)
        out.n_bytes += len(part)
        out.tail = (out.tail + part)[-16:]
        out.frames += 1
        out.hundredths += f.delay
        out.counts += histogram(own)
    out.digest = digest.hexdigest()
    return out


def media_table(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_media: bool = True) -> DataFrame:
    """Stores each text as a GIF and reads it back: the digest columns and, if asked, the file itself as media.

    Null text counts as empty; an empty text is one row of spaces. Equal texts give equal
    values; rows that repeat are each returned; texts of any length are stored whole, as many
    frames as they need. An empty table gives an empty one. Columns not named in ``keep`` are
    not returned; one in it that is named as an added one is replaced.
    """
    added = [("n_bytes", "long", pa.int64()), ("payload_bytes", "long", pa.int64()), ("payload_sha256", "string", pa.string()), ("tail_crc32", "long", pa.int64()), ("media_bytes", "long", pa.int64()), ("media_sha256", "string", pa.string()), ("feature", "string", pa.string())]
    added += [("media", "binary", pa.binary())] * with_media
    kept = carried(docs, keep, (n for n, _, _ in added))
    width = len(kept.inner)
    inner = docs.select(*kept.inner, text_of(text).alias("_pl_text"))

    def run(batches):
        for batch in sliced(batches):
            rows = []
            for value in batch.column(width).to_pylist():
                payload, n = payload_of(value)
                media = store_bytes(payload)
                back = read_back(frames_of(media))
                rows.append((n, back.n_bytes, back.digest, zlib.crc32(back.tail), len(media), hashlib.sha256(media).hexdigest(), back.feature, media if with_media else None))
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *(pa.array([r[i] for r in rows], t) for i, (_, _, t) in enumerate(added))], names=[*batch.schema.names[:width], *(n for n, _, _ in added)])

    return kept.named(inner.mapInArrow(run, ", ".join([*kept.schema, *(f"{n} {t}" for n, t, _ in added)])))


def frame_table(media: DataFrame, column: str = "media", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row for each frame of each GIF: frame_no, starts_at and delay (hundredths), width, height, histogram.

    A null file or one that cannot be read gives one row with a null frame_no and its error, after
    the frames before the fault.
    """
    added = [("frame_no", "int", pa.int32()), ("starts_at", "long", pa.int64()), ("delay", "int", pa.int32()), ("width", "int", pa.int32()), ("height", "int", pa.int32()), ("histogram", "array<long>", pa.list_(pa.int64())), ("error", "string", pa.string())]
    kept = carried(media, keep, (n for n, _, _ in added))
    width = len(kept.inner)
    inner = media.select(*kept.inner, column_of(column).alias("_pl_media"))

    def run(batches):
        for batch in sliced(batches):
            rows, source = [], []
            for i, raw in enumerate(batch.column(width).to_pylist()):
                at = 0
                try:
                    for k, f in enumerate(frames_of(raw or b"")):
                        rows.append((k, at, f.delay, f.canvas.shape[1], f.canvas.shape[0], histogram(f.canvas), None))
                        source.append(i)
                        at += f.delay
                except ValueError as e:
                    rows.append((None,) * 6 + (str(e),))
                    source.append(i)
            taken = batch.take(pa.array(source, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns[:width], *(pa.array([r[i] for r in rows], t) for i, (_, _, t) in enumerate(added))], names=[*batch.schema.names[:width], *(n for n, _, _ in added)])

    return kept.named(inner.mapInArrow(run, ", ".join([*kept.schema, *(f"{n} {t}" for n, t, _ in added)])))
