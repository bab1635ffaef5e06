"""MPEG audio as a media column: writing frames, and parsing any stream of them back.

The writer makes a stream that players accept: an ID3v2 tag, a frame with a variable-bitrate table (frame and byte counts,
seek table, quality), then silent Layer III frames of MPEG-2 at 16 kHz, mono, with checksums, whose ancillary bytes hold the
payload, 576 a frame. The reader assumes none of this: it parses tags at either end, walks from header to header, looks for
the next two agreeing headers after damage, verifies every checksum, reads Xing, Info and VBRI tables, and adds up exact
durations and the byte offset of every frame.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from fractions import Fraction
from itertools import takewhile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from habitus.llm.text import per_batch, raw

UNIT = 576  # payload bytes a frame; also the samples of an MPEG-2 Layer III frame

# Fixed values of the format: kilobits per second by (version 1?, layer), hertz by version, samples by (version 1?, layer).
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
SAMPLES = {(True, 1): 384, (True, 2): 1152, (True, 3): 1152, (False, 1): 384, (False, 2): 1152, (False, 3): 576}


def crc_table() -> list[int]:
    out = []
    for b in range(256):
        c = b << 8
        for _ in range(8):
            c = (c << 1) ^ (0x8005 if c & 0x8000 else 0)
        out.append(c & 0xFFFF)
    return out


CRC = crc_table()


def crc16(data: bytes) -> int:
    """The checksum of protected frames: polynomial 0x8005, all ones at first."""
    c = 0xFFFF
    for b in data:
        c = ((c << 8) & 0xFFFF) ^ CRC[(c >> 8) ^ b]
    return c


def header(data: bytes, at: int = 0) -> dict | None:
    """The fields of a frame header at this byte, or None if there is none. Free-format streams count as none."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xE0 != 0xE0:
        return None
    b1, b2, b3 = data[at + 1], data[at + 2], data[at + 3]
    version, layer = (b1 >> 3) & 3, 4 - ((b1 >> 1) & 3)
    rate_at, bit_at = (b2 >> 2) & 3, b2 >> 4
    if version == 1 or layer == 4 or rate_at == 3 or bit_at in (0, 15) or b3 & 3 == 2:
        return None
    one = version == 3
    kbps, hertz, samples, pad = BITRATES[one, layer][bit_at], RATES[version][rate_at], SAMPLES[one, layer], (b2 >> 1) & 1
    size = (12000 * kbps // hertz + pad) * 4 if layer == 1 else samples // 8 * 1000 * kbps // hertz + pad
    mono = b3 >> 6 == 3
    side = ((17 if mono else 32) if one else (9 if mono else 17)) if layer == 3 else 0
    return {"version": version, "layer": layer, "kbps": kbps, "hertz": hertz, "samples": samples, "size": size,
            "protected": not b1 & 1, "mono": mono, "side": side}


def agree(a: dict, b: dict) -> bool:
    return all(a[k] == b[k] for k in ("version", "layer", "hertz"))


def id3v2(data: bytes) -> tuple[int, dict[str, str]]:
    """The size of the tag at the front (0: none) and its text frames."""
    if data[:3] != b"ID3" or len(data) < 10 or any(b & 0x80 for b in data[6:10]):
        return 0, {}
    major, size = data[3], (data[6] << 21) | (data[7] << 14) | (data[8] << 7) | data[9]
    end, at, found = min(len(data), 10 + size), 10, {}
    while major in (3, 4) and at + 10 <= end and data[at] != 0:
        name, n = data[at : at + 4].decode("latin-1"), int.from_bytes(data[at + 4 : at + 8], "big")
        if major == 4:
            n = (data[at + 4] << 21) | (data[at + 5] << 14) | (data[at + 6] << 7) | data[at + 7]
        body = data[at + 10 : min(end, at + 10 + n)]
        if name[0] == "T" and body:
            code = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1")
            found[name] = body[1:].decode(code, "replace").strip("\0")
        at += 10 + n
    return 10 + size + (10 if data[5] & 0x10 else 0), found


def vbr_table(data: bytes, at: int, h: dict) -> dict | None:
    """A Xing, Info or VBRI table inside the frame at this byte."""
    end = at + h["size"]
    x = at + 4 + (2 if h["protected"] else 0) + h["side"]
    for x in (x, at + 4 + h["side"]):  # writers differ on whether the checksum moves it
        if data[x : x + 4] in (b"Xing", b"Info") and x + 8 <= end:
            kind, flags, p, out = data[x : x + 4].decode(), int.from_bytes(data[x + 4 : x + 8], "big"), x + 8, {}
            for bit, name in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    out[name], p = int.from_bytes(data[p : p + 4], "big"), p + 4
            if flags & 4:
                out["seek"], p = list(data[p : p + 100]), p + 100
            if flags & 8:
                out["quality"] = int.from_bytes(data[p : p + 4], "big")
            return {"kind": kind} | out
    v = at + 4 + 32
    if data[v : v + 4] == b"VBRI" and v + 26 <= end:
        quality, size, frames, entries, scale, width, _ = struct.unpack(">HIIHHHH", data[v + 8 : v + 26])
        seek = [int.from_bytes(data[v + 26 + i * width : v + 26 + (i + 1) * width], "big") * scale for i in range(entries)]
        return {"kind": "VBRI", "frames": frames, "bytes": size, "quality": quality, "seek": seek}
    return None


def walk(data: bytes, begin: int, stop: int) -> dict:
    """All frames from begin to stop; spans are (offset, size) of every whole frame, that of the table included."""
    frames, spans, table, skipped, bad, checked, at, synced = [], [], None, 0, 0, 0, begin, None
    while at + 4 <= stop:
        h = header(data, at)
        if h and (synced is None or not agree(h, synced)):
            after = at + h["size"]  # a lone header may be chance: two must follow, or the end of the stream
            for _ in range(2):
                nxt = header(data, after) if after + 4 <= stop else None
                if nxt is None or not agree(h, nxt):
                    h = h if after >= stop and after == stop else None
                    break
                after += nxt["size"]
        if h is None or at + h["size"] > stop:
            synced, step = None, data.find(b"\xff", at + 1, stop)
            step = stop if step < 0 else step
            skipped, at = skipped + step - at, step
            continue
        synced = h
        spans.append((at, h["size"]))
        if h["protected"] and h["layer"] == 3:
            checked += 1
            bad += crc16(data[at + 2 : at + 4] + data[at + 6 : at + 6 + h["side"]]) != int.from_bytes(data[at + 4 : at + 6], "big")
        if not frames and table is None and (table := vbr_table(data, at, h)):
            table["at"] = at
        else:
            frames.append((at, h))
        at += h["size"]
    skipped += stop - at if frames or table else 0
    return {"spans": spans, "table": table, "frames": frames, "skipped": skipped, "bad": bad, "checked": checked}


def parse(data: bytes) -> dict:
    """Everything about one stream; empty or foreign bytes give no frames. Long streams cost a step a frame.

    frames: (offset, header) of all audio frames; skipped: bytes passed over in search of a header; bad: failed checksums;
    duration: exact seconds as a fraction. Bytes inside a whole frame are never a tag, whatever they say.
    """
    begin, tags = id3v2(data)
    stop = len(data)
    out = walk(data, begin, stop)

    def framed(at: int) -> bool:
        return any(a < at < a + n for a, n in takewhile(lambda s: s[0] + s[1] > at, reversed(out["spans"])))

    if stop - 128 >= begin and data[stop - 128 : stop - 125] == b"TAG" and not framed(stop - 128):
        stop -= 128
        tags = {"TIT2": data[stop + 3 : stop + 33].decode("latin-1").strip("\0 ")} | tags
    if stop - 32 >= begin and data[stop - 32 : stop - 24] == b"APETAGEX" and not framed(stop - 32):
        stop -= min(stop - begin, int.from_bytes(data[stop - 20 : stop - 16], "little"))
    if stop < len(data):
        out = walk(data, begin, stop)
    del out["spans"]
    frames = out["frames"]
    time = sum((Fraction(n, hz) for n, hz in ((h["samples"], h["hertz"]) for _, h in frames)), Fraction(0)) if len({h["hertz"] for _, h in frames}) > 1 else (
        Fraction(sum(h["samples"] for _, h in frames), frames[0][1]["hertz"]) if frames else Fraction(0))
    return {"tags": tags} | out | {"duration": time}


def seek(parsed: dict, sample: int) -> int | None:
    """The byte offset of the frame that holds this sample, exactly; None past the end."""
    seen = 0
    for at, h in parsed["frames"]:
        if seen <= sample < seen + h["samples"]:
            return at
        seen += h["samples"]
    return None


# The writer's frame: 4 header bytes, 2 of checksum, 9 of side information (silence), 576 of payload, 57 of zero.
FRAME_HEAD = bytes((0xFF, 0xF2, 0xD8, 0xC0))  # MPEG-2, Layer III, protected, 144 kbps, 16 kHz, mono
FRAME_SIZE, BODY = 648, 15


def padded(data: bytes) -> bytes:
    """The payload: bytes 255 appended up to a positive multiple of the unit."""
    return data + b"\xff" * (max(1, -(-len(data) // UNIT)) * UNIT - len(data))


def write_stream(payload: bytes) -> bytes:
    """The stored form of a payload; its length is a positive multiple of the unit."""
    n = len(payload) // UNIT
    head = FRAME_HEAD + crc16(FRAME_HEAD[2:] + bytes(9)).to_bytes(2, "big") + bytes(9)
    body = np.zeros((n, FRAME_SIZE), np.uint8)
    body[:, :BODY] = np.frombuffer(head, np.uint8)
    body[:, BODY : BODY + UNIT] = np.frombuffer(payload, np.uint8).reshape(n, UNIT)
    size = (n + 1) * FRAME_SIZE
    points = bytes(min(255, (FRAME_SIZE * (1 + n * i // 100)) * 256 // size) for i in range(100))
    table = b"Info" + struct.pack(">III", 15, n, size) + points + struct.pack(">I", 100)
    title = b"\0payload of %d bytes" % len(payload)
    frame = b"TLEN" + struct.pack(">IH", len(length := b"\0%d" % (n * UNIT * 1000 // 16000)), 0) + length
    frame += b"TIT2" + struct.pack(">IH", len(title), 0) + title
    tag = b"ID3\x03\0\0" + bytes((len(frame) >> s) & 0x7F for s in (21, 14, 7, 0)) + frame
    return tag + (head + table).ljust(FRAME_SIZE, b"\0") + body.tobytes()


def read_payload(data: bytes, parsed: dict) -> bytes:
    """The payload bytes of all frames of a parsed stream, from behind each frame's side information."""
    at = [a + 4 + 2 * h["protected"] + h["side"] for a, h in parsed["frames"]]
    return b"".join(data[a : a + UNIT] for a in at)


def feature(data: bytes, parsed: dict) -> str:
    """The parsed facts of a stream in one line."""
    frames, table = parsed["frames"], parsed["table"] or {}
    offsets = np.fromiter((a for a, _ in frames), "<i8", len(frames))
    rates = sorted({h["kbps"] for _, h in frames})
    return (f"frames={len(frames)};seconds={parsed['duration']};kbps={'/'.join(map(str, rates))};table={table.get('kind', '')}:"
            f"{table.get('frames', '')}:{table.get('bytes', '')};crc={parsed['checked'] - parsed['bad']}/{parsed['checked']};"
            f"skipped={parsed['skipped']};title={parsed['tags'].get('TIT2', '')};offsets={zlib.crc32(offsets.tobytes())}")


def store(df: DataFrame, column: str = "text") -> DataFrame:
    """doc_id, n_bytes and the stored media of every text; null counts as empty, repeated rows stay."""

    def run(batch: pa.RecordBatch):
        texts = raw(batch.column(1))
        media = [write_stream(padded(t)) for t in texts]
        yield pa.record_batch([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return per_batch(df.select("doc_id", column), run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def inspect(df: DataFrame) -> DataFrame:
    """Parse the media column: hashes of payload and media, a line of features, the duration (duration_num / duration_den seconds, exactly, and
    seconds as a number), and offsets, the byte at which each frame starts.

    Null media counts as empty: no frames, no payload.
    """

    def run(batch: pa.RecordBatch):
        rows: list[list] = [[] for _ in range(10)]
        for data in (m or b"" for m in batch.column(2).to_pylist()):
            parsed = parse(data)
            payload = read_payload(data, parsed)
            values = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(),
                      feature(data, parsed), parsed["duration"].numerator, parsed["duration"].denominator, float(parsed["duration"]), [a for a, _ in parsed["frames"]])
            for column, value in zip(rows, values):
                column.append(value)
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int64()))
        names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "duration_num", "duration_den", "seconds", "offsets")
        yield pa.record_batch([batch.column(0), batch.column(1), *(pa.array(r, k) for r, k in zip(rows, kinds))], ["doc_id", "n_bytes", *names])

    return per_batch(df.select("doc_id", "n_bytes", "media"), run, (
        f"doc_id {df.schema['doc_id'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
        "media_bytes long, media_sha256 string, feature string, duration_num long, duration_den long, seconds double, offsets array<bigint>"))
