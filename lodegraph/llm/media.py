r"""Media columns: signature sniffing.

One Aho-Corasick pass over a value's bytes locates every known magic number; at each place a validator of that format
reads on and confirms structure and lengths (chunk checksums, block chains, sizes in headers), which also gives where
the medium ends. A medium that starts at byte 0 and fills the value is its true type and corrects a wrong declared
one; media found inside are carved out, outermost first, so that what a medium holds isn't carved again.

Formats: PNG, GIF, JPEG, BMP, WAV, AVI, WebP, FLAC, MP3 with ID3v2, Ogg, ISO base media (mp4 and kin), PDF, ZIP, gzip.

Null and empty values have no type. Values of any length are scanned whole. Equal values give equal results, and repeated
rows are read each; null ids pass; an empty table gives none. Only the columns named are read, so other columns' names
don't matter.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.llm.common import by_bytes, map_batches

#: Magic numbers of the formats.
MAGIC = {
    b"\x89PNG\r\n\x1a\n": "image/png",
    b"GIF87a": "image/gif",
    b"GIF89a": "image/gif",
    b"\xff\xd8\xff": "image/jpeg",
    b"BM": "image/bmp",
    b"RIFF": "riff",
    b"fLaC": "audio/flac",
    b"ID3": "audio/mpeg",
    b"OggS": "audio/ogg",
    b"ftyp": "video/mp4",
    b"%PDF-": "application/pdf",
    b"PK\x03\x04": "application/zip",
    b"\x1f\x8b\x08": "application/gzip",
}
BLOCK, WIDTH = 192, 64
_automaton = None


def automaton():
    global _automaton
    if _automaton is None:
        import ahocorasick

        made = ahocorasick.Automaton()
        for magic, kind in MAGIC.items():
            made.add_word(magic.decode("latin-1"), (len(magic), kind))
        made.make_automaton()
        _automaton = made
    return _automaton


def _png(b: bytes, at: int) -> tuple[str, int, str] | None:
    end, shape, data = at + 8, "", False
    while end + 12 <= len(b):
        size, kind = struct.unpack_from(">I4s", b, end)
        if end + 12 + size > len(b) or zlib.crc32(b[end + 4 : end + 8 + size]) != struct.unpack_from(">I", b, end + 8 + size)[0]:
            return None
        if not shape:
            if kind != b"IHDR" or size != 13:
                return None
            w, h, depth, colour = struct.unpack_from(">IIBB", b, end + 8)
            shape = f"{w}x{h}x{depth}c{colour}"
        data |= kind == b"IDAT"
        end += 12 + size
        if kind == b"IEND":
            return ("image/png", end, shape) if data else None
    return None


def _gif(b: bytes, at: int) -> tuple[str, int, str] | None:
    if at + 13 > len(b):
        return None
    w, h, flags = struct.unpack_from("<HHB", b, at + 6)
    end, images = at + 13 + (3 << (flags & 7) + 1 if flags & 128 else 0), 0
    while end < len(b):
        mark = b[end]
        if mark == 0x3B:
            return ("image/gif", end + 1, f"{w}x{h}") if images else None
        if mark == 0x21:
            end += 2
        elif mark == 0x2C:
            if end + 11 > len(b):
                return None
            local = b[end + 9]
            end += 11 + (3 << (local & 7) + 1 if local & 128 else 0)
            images += 1
        else:
            return None
        while end < len(b) and b[end]:
            end += 1 + b[end]
        end += 1
    return None


def _jpeg(b: bytes, at: int) -> tuple[str, int, str] | None:
    end, shape = at + 2, ""
    while end + 4 <= len(b) and b[end] == 0xFF:
        mark, size = b[end + 1], struct.unpack_from(">H", b, end + 2)[0]
        if size < 2 or mark in (0, 0xD8, 0xFF):
            return None
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC) and end + 9 <= len(b):
            h, w = struct.unpack_from(">HH", b, end + 5)
            shape = f"{w}x{h}"
        end += 2 + size
        if mark == 0xDA:
            while True:
                end = b.find(b"\xff", end)
                if end < 0 or end + 1 >= len(b):
                    return None
                if b[end + 1] == 0xD9:
                    return ("image/jpeg", end + 2, shape) if shape else None
                if b[end + 1] and not 0xD0 <= b[end + 1] <= 0xD7:
                    break
                end += 2
    return None


def _bmp(b: bytes, at: int) -> tuple[str, int, str] | None:
    if at + 54 > len(b):
        return None
    size, zero, start, head, w, h, planes, depth = struct.unpack_from("<IIIIiiHH", b, at + 2)
    row = (w * depth + 31) // 32 * 4
    if zero or planes != 1 or head not in (40, 108, 124) or depth not in (1, 4, 8, 16, 24, 32) or w <= 0 or not h or start < 14 + head or at + size > len(b) or start + row * abs(h) > size:
        return None
    return "image/bmp", at + size, f"{w}x{abs(h)}x{depth}"


def _riff(b: bytes, at: int) -> tuple[str, int, str] | None:
    if at + 12 > len(b):
        return None
    size, form = struct.unpack_from("<I4s", b, at + 4)
    stop, end, seen, shape = at + 8 + size, at + 12, [], ""
    kind = {b"WAVE": "audio/wav", b"AVI ": "video/avi", b"WEBP": "image/webp"}.get(form)
    if not kind or stop > len(b):
        return None
    while end + 8 <= stop:
        name, n = struct.unpack_from("<4sI", b, end)
        if end + 8 + n > stop:
            return None
        if name == b"fmt " and n >= 16:
            _, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", b, end + 8)
            shape = f"{channels}ch{bits}b{rate}"
        seen.append(name)
        end += 8 + n + n % 2
    whole = end == stop or end == stop + 1
    return (kind, min(max(end, stop), len(b)), shape) if whole and (kind != "audio/wav" or b"fmt " in seen and b"data" in seen) and seen else None


def _crc(value: bytes, width: int, polynomial: int) -> int:
    """Cyclic redundancy check, most significant bit first, from 0."""
    table, top, mask = _crc_table(width, polynomial), width - 8, (1 << width) - 1
    out = 0
    for x in value:
        out = (out << 8 & mask) ^ table[out >> top ^ x]
    return out


@lru_cache(maxsize=4)
def _crc_table(width: int, polynomial: int) -> list[int]:
    out, high, mask = [], 1 << width - 1, (1 << width) - 1
    for x in range(256):
        x <<= width - 8
        for _ in range(8):
            x = (x << 1 ^ polynomial) & mask if x & high else x << 1 & mask
        out.append(x)
    return out


def _flac_frame(b: bytes, at: int) -> int:
    """Length of a frame's header with its check, 0 where there is none."""
    if at + 6 > len(b) or b[at] != 0xFF or b[at + 1] & 0xFE != 0xF8:
        return 0
    size, rate, end = b[at + 2] >> 4, b[at + 2] & 15, at + 4
    if not size or rate == 15 or b[at + 3] & 1 or b[at + 3] >> 4 > 10:
        return 0
    extra = 0 if b[end] < 0x80 else 7 - (b[end] ^ 0xFF).bit_length()  # the coded number's further bytes
    end += 1 + extra + {6: 1, 7: 2}.get(size, 0) + {12: 1, 13: 2, 14: 2}.get(rate, 0)
    return end + 1 - at if end < len(b) and _crc(b[at:end], 8, 0x07) == b[end] else 0


def _flac(b: bytes, at: int) -> tuple[str, int, str] | None:
    """Metadata blocks, then frames: each begins with a header that its check confirms and ends in one over all of it."""
    end, first, last = at + 4, True, 0
    while not last:
        if end + 4 > len(b):
            return None
        last, kind, size = b[end] >> 7, b[end] & 127, int.from_bytes(b[end + 1 : end + 4], "big")
        if first and (kind or size != 34) or kind == 127 or end + 4 + size > len(b):
            return None
        end, first = end + 4 + size, False
    frames = 0
    while _flac_frame(b, end):
        # A frame's length isn't stated: it ends where its check holds, before another frame or where the medium ends.
        after, table, check, place = end, _crc_table(16, 0x8005), 0, 0
        for place in range(end, len(b)):
            if place >= end + 8 and check == int.from_bytes(b[place : place + 2], "big") and (place + 2 >= len(b) or _flac_frame(b, place + 2) or b[place + 2] != 0xFF):
                after = place + 2
                break
            check = (check << 8 & 0xFFFF) ^ table[check >> 8 ^ b[place]]
        if after == end:
            break
        end, frames = after, frames + 1
    return ("audio/flac", end, f"{frames}f") if frames else None


#: Kilobits a second of MPEG audio frames by version 1 or 2 and layer, and samples a second of version 1.
BIT_RATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
SAMPLE_RATES = (44100, 48000, 32000)


def _mpeg_frame(b: bytes, at: int) -> int:
    """Length of the MPEG audio frame at a place, by its header; 0 where there is none."""
    if at + 4 > len(b) or b[at] != 0xFF or b[at + 1] & 0xE0 != 0xE0:
        return 0
    version, layer, rate, speed = b[at + 1] >> 3 & 3, 4 - (b[at + 1] >> 1 & 3), b[at + 2] >> 4, b[at + 2] >> 2 & 3
    if version == 1 or layer == 4 or rate in (0, 15) or speed == 3:
        return 0
    bits, samples = BIT_RATES[1 if version == 3 else 2, layer][rate] * 1000, SAMPLE_RATES[speed] >> {3: 0, 2: 1, 0: 2}[version]
    pad = b[at + 2] >> 1 & 1
    return (12 * bits // samples + pad) * 4 if layer == 1 else (72 if layer == 3 and version != 3 else 144) * bits // samples + pad


def _id3(b: bytes, at: int) -> tuple[str, int, str] | None:
    """A tag of stated size, then whole frames, as many as follow each other, and the tag of 128 bytes at the end, if any."""
    if at + 10 > len(b) or b[at + 3] not in (2, 3, 4) or any(x & 128 for x in b[at + 6 : at + 10]):
        return None
    end, frames = at + 10 + sum((x & 127) << 7 * (3 - k) for k, x in enumerate(b[at + 6 : at + 10])), 0
    while (n := _mpeg_frame(b, end)) and end + n <= len(b):
        end, frames = end + n, frames + 1
    if not frames:
        return None
    return "audio/mpeg", end + 128 * (b[end : end + 3] == b"TAG" and end + 128 <= len(b)), f"{frames}f"


def _ogg(b: bytes, at: int) -> tuple[str, int, str] | None:
    end, pages = at, 0
    while b[end : end + 4] == b"OggS" and end + 27 <= len(b):
        n = b[end + 26]
        body = sum(b[end + 27 : end + 27 + n])
        if b[end + 4] or end + 27 + n + body > len(b):
            return None
        pages, final = pages + 1, b[end + 5] & 4
        end += 27 + n + body
        if final:
            return "audio/ogg", end, f"{pages}p"
    return None


def _mp4(b: bytes, at: int) -> tuple[str, int, str] | None:
    at -= 4
    end, names = at, []
    while at >= 0 and end + 8 <= len(b):
        size, name = struct.unpack_from(">I4s", b, end)
        if size < 8 or end + size > len(b) or not name.isalnum():
            break
        names.append(name)
        end += size
    return ("video/mp4", end, "") if b"moov" in names and names[0] == b"ftyp" else None


def _pdf(b: bytes, at: int) -> tuple[str, int, str] | None:
    """To the last end mark before another file's head: each update of a file adds a part with an end mark of its own. A
    part counts where its startxref names a cross-reference within it."""
    if not re.match(rb"%PDF-\d\.\d", b[at : at + 8]):
        return None
    following, end, parts = b.find(b"%PDF-", at + 5), 0, 0
    stop = following if following > 0 else len(b)
    for m in re.compile(rb"startxref\s+(\d+)\s+%%EOF").finditer(b, at, stop):
        place = at + int(m[1])
        if place < m.start() and (b.startswith(b"xref", place) or re.match(rb"\d+ \d+ obj", b[place : place + 24])):
            end, parts = m.end(), parts + 1
    return ("application/pdf", end, f"{parts}p") if parts else None


def _zip(b: bytes, at: int) -> tuple[str, int, str] | None:
    end = b.find(b"PK\x05\x06", at)
    if end < 0 or end + 22 > len(b):
        return None
    files, size, start, note = struct.unpack_from("<HIIH", b, end + 10)
    ok = start + size == end - at and b[at + start : at + start + 4] == (b"PK\x01\x02" if files else b"PK\x05\x06") and end + 22 + note <= len(b)
    return ("application/zip", end + 22 + note, f"{files}f") if ok else None


def _gzip(b: bytes, at: int) -> tuple[str, int, str] | None:
    if at + 18 > len(b) or b[at + 3] & 0xE0:
        return None
    unpack, fed, rest = zlib.decompressobj(31), at, b""
    try:
        while not unpack.eof and (rest or fed < len(b)):  # piece by piece, so that little is held at once
            if not rest:
                rest, fed = b[fed : fed + (64 << 10)], min(len(b), fed + (64 << 10))
            unpack.decompress(rest, 1 << 20)
            rest = unpack.unconsumed_tail
    except zlib.error:
        return None
    return ("application/gzip", fed - len(unpack.unused_data), "") if unpack.eof else None


VALIDATORS = {"image/png": _png, "image/gif": _gif, "image/jpeg": _jpeg, "image/bmp": _bmp, "riff": _riff, "audio/flac": _flac, "audio/mpeg": _id3, "audio/ogg": _ogg, "video/mp4": _mp4, "application/pdf": _pdf, "application/zip": _zip, "application/gzip": _gzip}


def sniff(value: bytes) -> list[tuple[str, int, int, str]]:
    """(type, start, end, shape) of the media in a value, outermost and leftmost first; overlapping ones aren't given."""
    found, over = [], 0
    for last, (size, kind) in automaton().iter(value.decode("latin-1")):
        at = last + 1 - size
        if at - 4 * (kind == "video/mp4") < over:
            continue
        if got := VALIDATORS[kind](value, at):
            found.append((got[0], at - 4 * (kind == "video/mp4"), got[1], got[2]))
            over = got[1]
    return found


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b" " * (-len(raw) % BLOCK if raw else BLOCK)


def as_png(payload: bytes) -> bytes:
    """Rows of WIDTH RGB pixels, 8 bits a sample, unfiltered."""
    stride = 3 * WIDTH
    rows = b"".join(b"\0" + payload[k : k + stride] for k in range(0, len(payload), stride))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", WIDTH, len(payload) // stride, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows, 1)) + chunk(b"IEND", b"")


def as_wav(payload: bytes) -> bytes:
    """One channel of unsigned 8-bit samples, 8,000 a second."""
    body = b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body


def samples(value: bytes, kind: str) -> bytes:
    """The samples of a PNG or WAV as written above."""
    if kind == "audio/wav":
        at = 12
        while value[at : at + 4] != b"data":
            at += 8 + struct.unpack_from("<I", value, at + 4)[0]
        return value[at + 8 : at + 8 + struct.unpack_from("<I", value, at + 4)[0]]
    at, packed = 8, b""
    parts = []
    while at < len(value):
        size, name = struct.unpack_from(">I4s", value, at)
        if name == b"IDAT":
            parts.append(value[at + 8 : at + 8 + size])
        at += 12 + size
    packed = zlib.decompress(b"".join(parts))
    stride = 3 * WIDTH + 1
    return b"".join(packed[k + 1 : k + stride] for k in range(0, len(packed), stride))


def store(df: DataFrame, row: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, n_bytes, declared, value): texts as media. The type declared is always image/png; by the payload's checksum
    half are WAV, and sniffing has to correct those."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, text):
            made = [padded(t) for t in batch.column(1).to_pylist()]
            values = [as_png(p) if zlib.crc32(p) & 1 else as_wav(p) for _, p in made]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in made], pa.int64()), pa.array(["image/png"] * len(made)), pa.array(values, pa.binary())], ["id", "n_bytes", "declared", "value"])

    kind = df.schema[row].dataType.simpleString()
    return map_batches(df.select(row, text), encode, f"id {kind}, n_bytes long, declared string, value binary").withColumnRenamed("id", row)


def sniffed(df: DataFrame, row: str = "doc_id", value: str = "value", declared: str = "declared", carve: bool = False) -> DataFrame:
    """A row for each value, or with `carve` for each medium in it: type, whether that corrects the declared one, place,
    shape, digests of the medium and of the samples of those that hold some, and with `carve` the medium itself."""
    schema = f"id {df.schema[row].dataType.simpleString()}, media_type string, corrected boolean, start long, length long, embedded long, shape string, media_sha256 string, payload_bytes long, payload_sha256 string, tail_crc32 long, medium binary"
    names = [x.split(" ")[0] for x in schema.split(", ")]
    kinds = [pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows, which = batch.column(0), [], []
            for k, (body, said) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                media = sniff(body or b"")
                for kind, start, end, shape in (media if carve else media[:1]) or [(None, None, None, None)]:
                    medium = None if kind is None else body[start:end]
                    own = samples(medium, kind) if kind in ("image/png", "audio/wav") and (kind == "audio/wav" or shape and shape.endswith("x8c2") and shape.startswith(f"{WIDTH}x")) else None
                    rows.append((kind, kind is not None and kind != said, start, None if kind is None else end - start, len(media) - bool(media and media[0][1] == 0), shape, hashlib.sha256(medium).hexdigest() if medium is not None else None, None if own is None else len(own), None if own is None else hashlib.sha256(own).hexdigest(), None if own is None else zlib.crc32(own[-16:]), medium if carve else None))
                    which.append(k)
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(which, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names)

    bare = df.select(row, value, declared)
    return map_batches(bare, read, schema).withColumnRenamed("id", row)


def media_features(df: DataFrame, row: str = "doc_id", text: str = "text") -> DataFrame:
    """Texts stored as media, then read back by sniffing: digests of what was read and a feature string."""
    schema = f"id {df.schema[row].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    names = [x.split(" ")[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for n, said, body in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                (kind, start, end, shape), *inner = sniff(body)
                medium = body[start:end]
                own = samples(medium, kind)
                rows.append((n, len(own), hashlib.sha256(own).hexdigest(), zlib.crc32(own[-16:]), len(medium), hashlib.sha256(medium).hexdigest(), f"{kind};{shape};{'corrected' if kind != said else 'as declared'};embedded={len(inner)}"))
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names)

    return map_batches(store(df, row, text), features, schema).withColumnRenamed("id", row)
