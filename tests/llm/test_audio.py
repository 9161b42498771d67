import hashlib
import zlib

import corpus
import pytest

from fieldloom.llm import audio


def test_round_trip_of_every_document(spark, tmp_path):
    rows = corpus.documents()
    texts = {d: (t or "").encode() for d, t, *_ in rows}
    got = audio.op3_audio(spark, corpus.saved(spark, tmp_path, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        raw = texts[r.doc_id]
        payload = raw + b" " * (192 if not raw else -len(raw) % 192)
        stream = audio.write_stream(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(stream), hashlib.sha256(stream).hexdigest())


@pytest.mark.parametrize("units", [1, 2, 3, 4, 5, 9, 401, 1000])
def test_stream(units):
    payload = bytes(k * 7 % 250 for k in range(units * 192))
    stream = audio.write_stream(payload)
    found = audio.read_stream(stream)
    assert audio.payload_of(found) == payload
    assert found["frames"] == found["vbr_frames"] == -(-units // 4) and found["samples"] == found["frames"] * 1152
    assert found["vbr_bytes"] == len(stream) - stream.index(b"\xff\xfa") and found["bad_checksums"] == found["resyncs"] == found["skipped_bytes"] == 0
    assert len(found["toc"]) == 100 and found["toc"] == sorted(found["toc"]) and found["tags"] == {"TXXX:payload": str(len(payload))}
    assert all(stream[k : k + 2] == b"\xff\xfa" for k in found["seek"])


def test_damage_is_found_and_passed():
    payload = bytes(range(192)) * 40
    stream = bytearray(audio.write_stream(payload))
    seek = audio.read_stream(bytes(stream))["seek"]
    stream[seek[2] + 10] ^= 1  # in the protected side information
    noise = b"\xff\xe0\xff\xfanoise" * 3
    hurt = bytes(stream[: seek[5]]) + noise + bytes(stream[seek[5] :]) + b"TAG" + b"title".ljust(30, b"\0") + bytes(95)
    found = audio.read_stream(hurt)
    assert found["bad_checksums"] == 1 and found["resyncs"] == 1 and found["skipped_bytes"] == len(noise) and found["frames"] == len(seek) and found["tags"]["TIT2"] == "title"
    assert audio.payload_of(found) == payload


def test_headers():
    head = audio.Header.of(b"\xff\xfb\x90\x64")
    assert (head.bitrate, head.rate, head.size, head.samples, head.side, head.protected) == (128, 44100, 417, 1152, 32, False)
    assert audio.Header.of(b"\xff\xfd\x84\x04").size == 144 * 128 * 1000 // 48000  # layer II, MPEG-1 at 128 kbit/s
    for bad in (b"\xff\xff\xff\xff", b"\xfe\xfb\x90\x64", b"\xff\xeb\x90\x64", b"\xff\xfb\x00\x64", b"\xff"):
        assert audio.Header.of(bad) is None
    assert audio.crc16(b"123456789") == 0xAEE7
    with pytest.raises(ValueError):
        audio.write_stream(b"x")


def test_table_of_the_other_kind():
    head = b"\xff\xfb\x90\x64"
    table = b"VBRI" + (1).to_bytes(2, "big") + bytes(4) + (9999).to_bytes(4, "big") + (3).to_bytes(4, "big") + b"\0\2\0\3\0\2\0\1" + b"\1\0\2\0"
    frame = lambda body=b"": (head + body).ljust(417, b"\0")
    found = audio.read_stream(frame(bytes(32) + table) + frame() * 3)
    assert (found["vbr_frames"], found["vbr_bytes"], found["toc"], found["frames"]) == (3, 9999, [768, 1536], 3)


@pytest.mark.parametrize("mode, size", [(0x00, 32), (0xC0, 16), (0x40, 18), (0x70, 24)])
def test_checksums_of_layer_one(mode, size):
    lead = bytes([0xFF, 0xFE, 0x94, mode])
    head = audio.Header.of(lead)
    assert head.layer == 1 and head.protected
    body = bytes(k % 251 for k in range(size))
    good = (lead + audio.crc16(lead[2:] + body).to_bytes(2, "big") + body).ljust(head.size, b"\0")
    bad = bytearray(good)
    bad[5 + size] ^= 1
    found = audio.read_stream(good + bytes(bad) + good)
    assert (found["frames"], found["checked"], found["bad_checksums"]) == (3, 3, 1)


def test_extended_and_unsynchronised_tags():
    size = lambda n: bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127])
    text = b"\0a\xff\0b"
    frame = b"TIT2" + (4).to_bytes(4, "big") + b"\0\0" + text
    old = (6).to_bytes(4, "big") + bytes(6) + frame
    assert audio.read_stream(b"ID3\3\0\xc0" + size(len(old)) + old)["tags"] == {"TIT2": "a\u00ffb"}
    frame = b"TIT2" + size(5) + b"\0\2" + text
    new = size(6) + b"\1\0" + frame
    assert audio.read_stream(b"ID3\4\0\x40" + size(len(new)) + new)["tags"] == {"TIT2": "a\u00ffb"}


def test_nulls_junk_and_clashing_names(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, bytearray(b""), "b"), (3, bytearray(b"\xff\xfb\x90\x64 no frames here"), "c")], "id long, media binary, audio string")
    rows = {r.id: r.audio for r in audio.parse(df).collect()}
    assert rows[1] is None and rows[2].frames == 0 and rows[3].frames == 0 and rows[3].layer is None and rows[3].skipped_bytes == 19
    assert audio.parse(df.limit(0)).count() == 0 and audio.write(df.limit(0).withColumnRenamed("media", "payload")).count() == 0
