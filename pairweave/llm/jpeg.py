"""Media columns: bytes stored as baseline JPEG, read back as DC-only luminance thumbnails.

The reader parses markers and tables of any baseline (SOF0) file, interleaved or with a
scan for each component, Huffman-decodes the entropy-coded segments and keeps the DC
coefficient of every luminance block, so a thumbnail has one pixel for each 8 x 8 block. The segments between restart markers of
all files of a batch that share their tables are decoded in step, one numpy operation
for all of them, which is what makes this fast without compiled code.

The writer stores a payload without loss: one grey block for each byte, DC quantiser 8,
so the DC coefficient is the byte less 128 and the thumbnail's pixel is the byte. A
restart marker follows every 24 blocks. A comment marker holds the payload's length. Long
payloads are cut into several files, one behind the other.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame

from pairweave.llm.arrow import map_rows, with_columns

UNIT = 576
#: Blocks in a restart interval, and the least width in blocks.
RUN = 24
_MOST_BLOCKS = 65535 // 8
#: Payload bytes that are handled at once, at least one file.
CHUNK = 1 << 20

# Code lengths of the writer's Huffman codes: DC by category 0 to 8, made for byte differences; AC: end of block only.
_DC_LENGTHS = (4, 6, 4, 3, 3, 2, 2, 4, 6)


def canonical(lengths: dict[int, int]) -> tuple[list[int], list[int], dict[int, int]]:
    """Counts by length 1 to 16, symbols in order, and the code of every symbol."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    counts = [sum(n == k for n in lengths.values()) for k in range(1, 17)]
    codes, code, last = {}, 0, 0
    for s in order:
        code <<= lengths[s] - last
        last = lengths[s]
        codes[s] = code
        code += 1
    return counts, order, codes


_DC_COUNTS, _DC_ORDER, _DC_CODES = canonical(dict(enumerate(_DC_LENGTHS)))
_AC_COUNTS, _AC_ORDER, _ = canonical({0: 1})
_CATEGORY = np.array([0, *(int(i).bit_length() for i in range(1, 512))], np.int64)
_CODE = np.array([_DC_CODES[c] for c in range(9)], np.int64)
_LENGTH = np.array(_DC_LENGTHS, np.int64)


def shape_of(n_payload: int) -> tuple[int, int]:
    """Width and height in blocks for a payload: RUN blocks wide, more only where the height would not fit."""
    times = 1
    while -(-n_payload // (RUN * times)) > _MOST_BLOCKS:
        times *= 2
    if RUN * times > _MOST_BLOCKS:
        raise ValueError(f"{n_payload} bytes do not fit in one file")
    return RUN * times, -(-n_payload // (RUN * times))


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


_TABLES = (
    _segment(0xDB, bytes([0]) + bytes([8]) * 64)
    + _segment(0xC4, bytes([0x00, *_DC_COUNTS, *_DC_ORDER]))
    + _segment(0xC4, bytes([0x10, *_AC_COUNTS, *_AC_ORDER]))
    + _segment(0xDD, struct.pack(">H", RUN))
)


def write(payloads: list[bytes]) -> list[bytes]:
    """A baseline JPEG file for each payload; no payload may be empty."""
    shapes = [shape_of(len(p)) for p in payloads]
    blocks = [w * h for w, h in shapes]
    values = np.zeros(sum(blocks), np.int64)
    at = 0
    for p, n in zip(payloads, blocks, strict=True):
        values[at : at + len(p)] = np.frombuffer(p, np.uint8)
        values[at : at + len(p)] -= 128
        at += n
    rows = values.reshape(-1, RUN)
    d = rows.copy()
    d[:, 1:] -= rows[:, :-1]
    category = _CATEGORY[np.abs(d)]
    extra = np.where(d < 0, d + (1 << category) - 1, d)
    code = ((_CODE[category] << category) | extra) << 1  # the end of block is a zero bit
    length = _LENGTH[category] + category + 1
    ends = np.cumsum(length, 1)
    size = (ends[:, -1] + 7) // 8
    base = np.concatenate(([0], np.cumsum(size)))
    bit = base[:-1, None] * 8 + ends - length
    word = (code << (24 - length - (bit & 7))).ravel()
    byte = (bit >> 3).ravel()
    out = np.zeros(int(base[-1]) + 3, np.int64)
    for k in range(3):
        out += np.bincount(byte + k, (word >> (16 - 8 * k)) & 255, len(out)).astype(np.int64)[: len(out)]
    out = out[: int(base[-1])]
    out[base[1:] - 1] |= (1 << (size * 8 - ends[:, -1])) - 1
    out = out.astype(np.uint8)
    # a zero behind every 255, a restart marker behind every interval
    stuffed = np.cumsum(out == 255)
    interval = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(out)) + stuffed - (out == 255) + 2 * interval
    full = np.zeros(len(out) + int(stuffed[-1]) + 2 * len(size), np.uint8)
    full[place] = out
    stop = base[1:] + stuffed[base[1:] - 1] + 2 * np.arange(len(size))
    first = np.cumsum([0, *(n // RUN for n in blocks)])
    full[stop] = 255
    full[stop + 1] = 0xD0 + (np.arange(len(size)) - np.repeat(first[:-1], np.diff(first))) % 8
    files = []
    for i, (p, (w, h)) in enumerate(zip(payloads, shapes, strict=True)):
        lo = 0 if not first[i] else int(stop[first[i] - 1]) + 2
        frame = _segment(0xC0, struct.pack(">BHHB", 8, 8 * h, 8 * w, 1) + bytes([1, 0x11, 0]))
        head = b"\xff\xd8" + _segment(0xFE, b"payload " + str(len(p)).encode()) + _TABLES + frame + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
        files.append(head + full[lo : int(stop[first[i + 1] - 1])].tobytes() + b"\xff\xd9")
    return files


class Image:
    """What the markers of a baseline file say, and where the scan with its first component lies.

    The file begins at ``data[start]``; ``end`` is where it stops. Tables are those in
    force when that scan begins, and scans of other components are stepped over. Anything
    that is no whole baseline file raises ValueError.
    """

    def __init__(self, data: bytes, start: int = 0) -> None:
        if data[start : start + 2] != b"\xff\xd8":
            raise ValueError("no JPEG")
        self.data, self.restart, self.comment = data, 0, b""
        self.components: list[tuple[int, int, int, int]] = []  # id, h, v, quantiser
        self.mcu: tuple | None = None
        self.quant, self.huffman = {}, {}
        try:
            self._read(start + 2)
        except (IndexError, KeyError, struct.error) as error:
            raise ValueError(f"broken markers: {error}") from None
        if self.mcu is None:
            raise ValueError("no scan")

    def _read(self, at: int) -> None:
        data = self.data
        while True:
            while data[at] != 0xFF or data[at + 1] in (0xFF, 0):
                at += 1
            marker = data[at + 1]
            if marker == 0xD9:
                self.end = at + 2
                return
            if marker in (0x01, *range(0xD0, 0xD8)):
                at += 2
                continue
            size = struct.unpack_from(">H", data, at + 2)[0]
            body = data[at + 4 : at + 2 + size]
            if len(body) != size - 2:
                raise ValueError("cut short")
            at += 2 + size
            if marker == 0xC0:
                _, self.height, self.width, n = struct.unpack_from(">BHHB", body)
                self.components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
                if not (self.height and self.width and n and all(1 <= h <= 4 and 1 <= v <= 4 for _, h, v, _ in self.components)):
                    raise ValueError("no size")
            elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                raise ValueError("not baseline")
            elif marker == 0xDB:
                while body:
                    wide = 2 if body[0] >> 4 else 1
                    self.quant[body[0] & 15] = body[1] if wide == 1 else struct.unpack_from(">H", body, 1)[0]
                    body = body[1 + 64 * wide :]
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    self.huffman[body[0]] = (bytes(body[1:17]), bytes(body[17 : 17 + n]))
                    if len(body) < 17 + n:
                        raise ValueError("cut short")
                    body = body[17 + n :]
            elif marker == 0xDD:
                self.restart = struct.unpack(">H", body)[0]
            elif marker == 0xFE:
                self.comment = bytes(body)
            elif marker == 0xDA:
                stop = self._scan_end(at)
                if self.mcu is None:
                    self._scan(body, at, stop)
                at = stop

    def _scan_end(self, at: int) -> int:
        """Where the next marker stands that is no restart marker."""
        while True:
            at = self.data.find(b"\xff", at)
            if at < 0 or at + 1 >= len(self.data):
                raise ValueError("cut short")
            if self.data[at + 1] == 0xFF:
                at += 1
            elif self.data[at + 1] == 0 or 0xD0 <= self.data[at + 1] <= 0xD7:
                at += 2
            else:
                return at

    def _scan(self, body: bytes, begin: int, stop: int) -> None:
        tables = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])}
        if not self.components or self.components[0][0] not in tables:
            return  # a scan of other components
        self.begin, self.stop, self.q = begin, stop, self.quant[self.components[0][3]]
        hm, vm = max(c[1] for c in self.components), max(c[2] for c in self.components)
        here = [c for c in self.components if c[0] in tables]
        _, h, v, _ = self.components[0]
        # the component's own size in blocks
        self.columns, self.rows = -(-(-(-self.width * h // hm)) // 8), -(-(-(-self.height * v // vm)) // 8)
        if len(here) == 1:  # a component alone is dealt block by block
            self.h = self.v = 1
            self.across, self.down = self.columns, self.rows
        else:
            self.h, self.v = h, v
            self.across, self.down = -(-self.width // (8 * hm)), -(-self.height // (8 * vm))
        # blocks of one MCU: component number, DC table, AC table
        self.mcu = tuple(
            (i, self.huffman[tables[c[0]][0]], self.huffman[0x10 | tables[c[0]][1]])
            for i, c in enumerate(self.components) if c[0] in tables for _ in range(1 if len(here) == 1 else c[1] * c[2])
        )
        self.interval = self.restart

    def key(self) -> tuple:
        """Files with equal keys can be decoded in step."""
        return self.mcu, self.interval

    def segments(self) -> tuple[np.ndarray, np.ndarray]:
        """Entropy-coded bytes without stuffing and markers, and where each restart interval starts."""
        raw = np.frombuffer(self.data, np.uint8)[self.begin : self.stop]
        after = np.append(raw[1:], 0xD9)
        ff = raw == 255
        marks = np.flatnonzero(ff & (after >= 0xD0) & (after <= 0xD7))
        keep = np.ones(len(raw), bool)
        keep[marks] = False
        keep[marks + 1] = False
        keep[1:] &= ~(ff[:-1] & (raw[1:] == 0))
        kept = np.concatenate(([0], np.cumsum(keep)))
        return raw[keep], np.concatenate(([0], kept[marks]))


_LOOKUPS: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}


def _lookup(table: tuple[bytes, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and length for the next 16 bits; length 0 where no code matches."""
    if table not in _LOOKUPS:
        symbol, length, at, code, s = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 0, 0, 0
        for n, count in enumerate(table[0], 1):
            for _ in range(count):
                at = code << (16 - n)
                symbol[at : at + (1 << (16 - n))], length[at : at + (1 << (16 - n))] = table[1][s], n
                code, s = code + 1, s + 1
            code <<= 1
        _LOOKUPS[table] = symbol, length
    return _LOOKUPS[table]


def _coefficients(images: list[Image]) -> list[np.ndarray | None]:
    """DC values (MCU, blocks of the first component in it) of files with one key; None for one whose data are broken."""
    mcu, restart = images[0].key()
    n_mcu, starts, counts, parts, owner, ends, at = [], [], [], [], [], [], 0
    for n, image in enumerate(images):
        data, begin = image.segments()
        total = image.across * image.down
        each = restart or total
        k = min(-(-total // each), len(begin))
        n_mcu.append(total)
        starts.append(begin[:k] + at)
        ends.append(np.append(begin[1:k], len(data)) + at)
        counts.append(np.minimum(each, total - each * np.arange(k)))
        owner += [n] * k
        parts.append(data)
        at += len(data)
    buffer = np.concatenate([*parts, np.full(8, 255, np.uint8)]).astype(np.int64)
    window = (buffer[:-4] << 32) | (buffer[1:-3] << 24) | (buffer[2:-2] << 16) | (buffer[3:-1] << 8) | buffer[4:]
    position, count, stop = np.concatenate(starts) * 8, np.concatenate(counts), np.concatenate(ends) * 8
    last = 8 * (len(window) - 1)
    wrong = np.zeros(len(position), bool)

    def peek(p: np.ndarray, n: int = 16) -> np.ndarray:
        p = np.minimum(p, last)
        return (window[p >> 3] >> (40 - n - (p & 7))) & ((1 << n) - 1)

    luma = sum(b[0] == 0 for b in mcu)
    out = np.zeros((int(count.sum()), luma), np.int64)
    offset = np.concatenate(([0], np.cumsum(count)[:-1]))
    predicted = np.zeros((len(position), 1 + max(b[0] for b in mcu)), np.int64)
    for m in range(int(count.max(initial=0))):
        on = np.flatnonzero(count > m) if m >= count.min() else slice(None)
        p, slot = position[on], 0
        bad = np.zeros(len(p), bool)
        for component, dc, ac in mcu:
            symbols, lengths = _lookup(dc)
            bits = peek(p)
            category, step = np.minimum(symbols[bits], 15), lengths[bits]
            bad |= step == 0
            p = p + step
            x = peek(p) >> (16 - category)
            value = np.where(category == 0, 0, np.where(x >> np.maximum(category - 1, 0), x, x - (1 << category) + 1))
            p = p + category
            predicted[on, component] += value
            if component == 0:
                out[offset[on] + m, slot] = predicted[on, 0]
                slot += 1
            symbols, lengths = _lookup(ac)
            bits = peek(p)
            s, step = symbols[bits], lengths[bits]
            bad |= step == 0
            p = p + step + (s & 15)
            k = 1 + (s >> 4) + 1
            live = np.flatnonzero((s != 0) & (k < 64) & (step > 0))
            while len(live):
                bits = peek(p[live])
                s, step = symbols[bits], lengths[bits]
                bad[live] |= step == 0
                p[live] += step + (s & 15)
                k[live] += (s >> 4) + 1
                live = live[(s != 0) & (k[live] < 64) & (step > 0)]
        position[on] = p
        wrong[on] |= bad
    wrong |= position > stop
    broken = set(np.array(owner)[wrong].tolist())
    done, at = [], 0
    for n, each in enumerate(counts):
        size = int(each.sum())
        done.append(None if n in broken or size != n_mcu[n] else out[at : at + size])
        at += size
    return done


def thumbnails(files: list[bytes]) -> list[tuple[Image, np.ndarray]]:
    """For each file its markers and the luminance thumbnail, one pixel a block; a file that can't be read raises ValueError."""
    found = _thumbnails([Image(f) for f in files])
    if any(x is None for x in found):
        raise ValueError("broken data")
    return found


def _thumbnails(images: list[Image]) -> list[tuple[Image, np.ndarray] | None]:
    groups: dict[tuple, list[int]] = {}
    for i, image in enumerate(images):
        groups.setdefault(image.key(), []).append(i)
    found: list = [None] * len(images)
    for members in groups.values():
        for i, dc in zip(members, _coefficients([images[i] for i in members]), strict=True):
            if dc is None:
                continue
            image = images[i]
            h, v = image.h, image.v
            grid = dc.reshape(image.down, image.across, v, h).transpose(0, 2, 1, 3).reshape(image.down * v, image.across * h)
            pixels = np.clip((grid * image.q + 4) // 8 + 128, 0, 255).astype(np.uint8)
            found[i] = image, pixels[: image.rows, : image.columns]
    return found


def thumbnail_hash(pixels: np.ndarray) -> str:
    """64 bits in hex: whether the mean grows from cell to cell along the rows of an 8 by 9 grid."""
    h, w = pixels.shape
    if h < 8 or w < 9:
        pixels = pixels[np.minimum(np.arange(max(h, 8)), h - 1)][:, np.minimum(np.arange(max(w, 9)), w - 1)]
        h, w = pixels.shape
    y, x = np.arange(9) * h // 8, np.arange(10) * w // 9
    sums = np.add.reduceat(np.add.reduceat(pixels.astype(np.int64), y[:-1], 0), x[:-1], 1)
    # whole means, so that rounding plays no part
    mean = sums * 1000 // (np.diff(y)[:, None] * np.diff(x)[None, :])
    return np.packbits(mean[:, 1:] > mean[:, :-1]).tobytes().hex()


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes of the text, filled with 255 up to a positive multiple of UNIT; and their number without filling."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\xff" * (-len(raw) % UNIT or (UNIT if not raw else 0)), len(raw)


def _in_chunks(items: list, size) -> list[list]:
    out, total = [[]], 0
    for x in items:
        if out[-1] and total + size(x) > CHUNK:
            out.append([])
            total = 0
        out[-1].append(x)
        total += size(x)
    return out


def media_of(payloads: list[bytes]) -> list[bytes]:
    """Every payload as one JPEG file, or, beyond CHUNK bytes, as files of CHUNK bytes one behind the other."""
    parts = [p[a : a + CHUNK] for p in payloads for a in range(0, max(len(p), 1), CHUNK)]
    files = iter([f for some in _in_chunks(parts, len) if some for f in write(some)])
    return [b"".join(next(files) for _ in range(0, max(len(p), 1), CHUNK)) for p in payloads]


def images_of(media: bytes) -> list[Image]:
    """The files that stand one behind the other in a media value; bytes behind the last one are no matter."""
    out = [Image(media)]
    while media[out[-1].end : out[-1].end + 2] == b"\xff\xd8":
        out.append(Image(media, out[-1].end))
    return out


def read_all(values: list[bytes | None]) -> list[tuple[bytes | None, str | None, str | None]]:
    """For each media value the payload, the feature and, if it can't be read, what is wrong with it."""
    done: list = [(None, None, "null")] * len(values)
    sound = []
    for i, media in enumerate(values):
        if media is None:
            continue
        try:
            sound += [(i, image) for image in images_of(media)]
        except ValueError as error:
            done[i] = None, None, str(error)
    payloads: dict[int, list[bytes]] = {}
    features: dict[int, list[str]] = {}
    for some in _in_chunks(sound, lambda x: x[1].stop - x[1].begin):
        for (i, _), got in zip(some, _thumbnails([image for _, image in some]), strict=True):
            if got is None:
                done[i] = None, None, "broken data"
                continue
            image, pixels = got
            flat = pixels.tobytes()
            n = int(image.comment[8:]) if image.comment.startswith(b"payload ") and image.comment[8:].isdigit() else len(flat)
            payloads.setdefault(i, []).append(flat[:n])
            features.setdefault(i, []).append(f"{image.width}x{image.height}:{pixels.shape[1]}x{pixels.shape[0]}:{thumbnail_hash(pixels)}")
    for i, parts in payloads.items():
        if done[i][2] != "broken data":
            done[i] = b"".join(parts), "+".join(features[i]), None
    return done


def stored(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media, the text's payload as baseline JPEG, for every row of docs.

    A null text counts as empty; an empty one is stored as UNIT filling bytes. A payload
    above CHUNK bytes becomes several files one behind the other, so no text is too long
    and memory is bounded. Equal texts give equal values; repeated rows and rows with a
    null doc_id are stored like others. An empty table gives an empty result. Other
    columns, whatever their names, are not read.
    """

    def make():
        def run(texts):
            made = [payload_of(t) for t in texts]
            return [[n for _, n in made], media_of([p for p, _ in made])]

        return run

    return map_rows(docs.select("doc_id", "text"), make, "n_bytes long, media binary", keep=1, rows=256)


def media_features(media: DataFrame) -> DataFrame:
    """All columns of media and, read back from its column ``media``: payload (binary), feature and error.

    feature holds width, height, the thumbnail's size and its hash, of each of the files in
    the value, joined by "+". The payload is the thumbnails' pixels, of each up to the
    length in the file's comment, all of them without one. A value that is null or no
    whole baseline file has a null payload and feature, and error says what is wrong; it
    is null for all others. Columns of media with the names of new ones are replaced. An
    empty table gives an empty result.
    """

    def make():
        return lambda files: list(map(list, zip(*read_all(files), strict=True)))

    return with_columns(media, ["media"], make, "payload binary, feature string, error string", rows=256)


def media_digests(features: DataFrame) -> DataFrame:
    """Sizes and digests of the columns media and payload, beside doc_id, n_bytes and feature; null for null values."""

    def make():
        def run(media, payloads):
            of = lambda f, values: [None if x is None else f(x) for x in values]
            sha = lambda x: hashlib.sha256(x).hexdigest()
            return [of(len, payloads), of(sha, payloads), of(lambda p: zlib.crc32(p[-32:]), payloads), of(len, media), of(sha, media)]

        return run

    rows = features.select("doc_id", "n_bytes", "feature", "media", "payload")
    columns = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string"
    return map_rows(rows, make, columns, keep=3).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
