"""MPEG audio: round trips, tags, tables, damage and exact durations."""

import struct
import zlib
from fractions import Fraction

from habitus.llm import mpeg_audio as M


def frame(kbps_at, body=b"", one=True, mono=False, protect=False):
    """An MPEG-1 (44.1 kHz) or MPEG-2 (22.05 kHz) Layer III frame of the given bitrate index."""
    head = bytes((0xFF, (0xFA if one else 0xF2) | (not protect), kbps_at << 4, 0xC0 if mono else 0))
    h = M.header(head)
    side = bytes(h["side"])
    check = M.crc16(head[2:] + side).to_bytes(2, "big") if protect else b""
    return (head + check + side + body).ljust(h["size"], b"\0")


def test_round_trip_of_every_length():
    for n in (0, 1, 575, 576, 577, 5000):
        data = bytes(i * 7 % 256 for i in range(n))
        payload = M.padded(data)
        media = M.write_stream(payload)
        parsed = M.parse(media)
        assert len(payload) % 576 == 0 and payload and M.read_payload(media, parsed) == payload
        assert parsed["skipped"] == parsed["bad"] == 0 and parsed["checked"] == len(parsed["frames"]) + 1
        assert parsed["table"]["kind"] == "Info" and parsed["table"]["frames"] == len(parsed["frames"])
        assert parsed["table"]["bytes"] == len(media) - M.id3v2(media)[0] and parsed["duration"] == Fraction(len(payload), 16000)
        assert parsed["tags"]["TIT2"] == f"payload of {len(payload)} bytes"


def test_payload_that_looks_like_headers():
    payload = M.padded(M.FRAME_HEAD * 1000)
    media = M.write_stream(payload)
    assert M.read_payload(media, M.parse(media)) == payload


def test_variable_bitrates_duration_and_offsets():
    parts = [frame(k) for k in (9, 5, 14, 1, 9)]
    data = b"".join(parts)
    parsed = M.parse(data)
    assert [a for a, _ in parsed["frames"]] == [sum(map(len, parts[:i])) for i in range(5)]
    assert parsed["duration"] == Fraction(5 * 1152, 44100)
    assert M.seek(parsed, 0) == 0 and M.seek(parsed, 1152) == len(parts[0]) and M.seek(parsed, 5 * 1152) is None


def test_damage_is_passed_over():
    good = [frame(9, protect=True) for _ in range(8)]
    data = b"junk\xff\xfb" + b"".join(good[:4]) + b"\xff\xff\xe0 noise \xff\xfb\x90" + b"".join(good[4:]) + b"TAG" + b"name".ljust(125, b"\0")
    parsed = M.parse(data)
    assert len(parsed["frames"]) == 8 and parsed["bad"] == 0 and parsed["skipped"] == 6 + 13 and parsed["tags"]["TIT2"] == "name"
    broken = bytearray(b"".join(good))
    broken[len(good[0]) * 3 + 10] ^= 4
    assert M.parse(bytes(broken))["bad"] == 1


def test_tables():
    xing = b"Xing" + struct.pack(">III", 7, 2, 1000) + bytes(range(100))
    data = frame(9, xing) + frame(9) + frame(9)
    parsed = M.parse(data)
    assert parsed["table"] == {"kind": "Xing", "frames": 2, "bytes": 1000, "seek": list(range(100)), "at": 0} and len(parsed["frames"]) == 2
    vbri = b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 75, 900, 2, 2, 3, 2, 1) + struct.pack(">HH", 5, 6)
    first = frame(9)
    first = first[:36] + vbri + first[36 + len(vbri):]
    table = M.parse(first + frame(9) + frame(9))["table"]
    assert (table["kind"], table["frames"], table["bytes"], table["seek"]) == ("VBRI", 2, 900, [15, 18])


def test_foreign_and_empty_bytes():
    for data in (b"", b"\xff", b"\xff\xfb", b"plain text" * 50, b"ID3", b"\xff" * 1000):
        parsed = M.parse(data)
        assert parsed["frames"] == [] and parsed["duration"] == 0


def test_known_checksum():
    assert M.crc16(b"123456789") == 0xAEE7


def test_rows(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "x" * 2000, "c"), (3, "x" * 2000, "c"), (None, "é", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, media string")
    got = M.inspect(M.store(df)).collect()
    media = {r.doc_id: r.media for r in M.store(df).collect()}
    assert sorted((r.doc_id or 0, r.n_bytes, r.payload_bytes) for r in got) == [(0, 2, 576), (1, 0, 576), (2, 0, 576), (3, 2000, 2304), (3, 2000, 2304)]
    for r in got:
        text = {k: t for k, t, _ in rows}[r.doc_id] or ""
        assert r.payload_sha256 == __import__("hashlib").sha256(M.padded(text.encode())).hexdigest()
        assert r.tail_crc32 == zlib.crc32(M.padded(text.encode())[-32:]) and r.seconds == r.payload_bytes / 16000
        assert r.duration_num * 16000 == r.payload_bytes * r.duration_den and len(r.offsets) == r.payload_bytes // 576
        data = bytes(media[r.doc_id])
        assert all(data[a : a + 4] == M.FRAME_HEAD for a in r.offsets) and b"".join(data[a + M.BODY : a + M.BODY + 576] for a in r.offsets) == M.padded(text.encode())
    assert M.inspect(M.store(df.limit(0))).count() == 0


def test_a_tag_inside_the_last_frame_is_payload():
    for units in (1, 3):
        for at in (504, 505, 506):
            text = bytearray(b"x" * (units * 576))
            text[at - 576 : at - 573] = b"TAG"  # 505: 128 bytes before the end of the stream
            media = M.write_stream(bytes(text))
            assert at != 505 or media[-128:-125] == b"TAG"
            tagged = media + b"TAG" + b"name".ljust(125, b"\0")
            for data in (media, tagged):
                parsed = M.parse(data)
                assert M.read_payload(data, parsed) == bytes(text) and len(parsed["frames"]) == units and parsed["skipped"] == parsed["bad"] == 0
    lone = frame(9, b"x" * 253 + b"TAG")
    assert lone[-128:-125] == b"TAG" and len(M.parse(lone)["frames"]) == 1 and not M.parse(lone)["tags"]
    tagged = M.parse(frame(9) + b"TAG" + b"name".ljust(125, b"\0"))
    assert len(tagged["frames"]) == 1 and tagged["tags"] == {"TIT2": "name"}
    foot = b"APETAGEX" + struct.pack("<IIII", 2000, 32, 0, 0) + bytes(8)
    assert len(M.parse(frame(9) * 3 + foot)["frames"]) == 3
    assert len(M.parse(frame(9) * 2 + frame(9)[:-32] + foot)["frames"]) == 3
