"""MPEG audio in columns: writing and reading elementary streams.

Reading: skip an ID3v2 tag, find frame headers and resynchronise after
damage (a header counts if another compatible one or the end follows it), parse
the tags (text frames of ID3v2.3 and 2.4, ID3v1) and the Xing, Info or VBRI table
of variable bitrate, verify the CRC-16 of protected frames of layers I and III, and
give exact durations as samples and rate, and the byte offset of every frame for
seeking. Frames of layer II are read, but their CRC, which covers a varying number
of bits, isn't verified: ``checked`` counts those that were.

Writing: a payload goes into MPEG-1 layer III frames (48 kHz, two channels,
protected) whose side information declares no audio bits, so that a player
hears silence and the payload rides as ancillary bytes. Whole units of 192
bytes are dealt to frames of 768, 576, 384 or 192 of them, so the stream has a
variable bitrate; its first frame is a Xing table, an ID3v2 tag leads it.

Defined results: null content reads as null columns; content without any
frame has 0 frames and no duration; bytes that belong to nothing are counted
in ``skipped_bytes``; equal payloads give equal streams; repeated rows give
repeated results and an empty table an empty one; time and memory go in proportion
to the longest stream; columns of the input stay, but for those named like results.
"""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNIT = 192

# Fixed values of the MPEG audio format (ISO 11172-3, 13818-3): kbit/s by (version 1?, layer) and index, Hz by version and index.
_BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
#: Units in a frame -> index of its bitrate (frame of 240, 480, 672 or 960 bytes at 48 kHz).
_FRAMES = {1: 6, 2: 10, 3: 12, 4: 14}
_LEAD = 4 + 2 + 32


def _crc_table() -> list[int]:
    out = []
    for byte in range(256):
        value = byte << 8
        for _ in range(8):
            value = ((value << 1) ^ 0x8005 if value & 0x8000 else value << 1) & 0xFFFF
        out.append(value)
    return out


_CRC = _crc_table()


def crc16(data: bytes) -> int:
    """The checksum of protected frames (polynomial 8005, start FFFF)."""
    value = 0xFFFF
    for byte in data:
        value = ((value << 8) & 0xFFFF) ^ _CRC[(value >> 8) ^ byte]
    return value


class Header:
    """A frame header's fields; ``None`` from :meth:`of` if the four bytes aren't one."""

    __slots__ = ("version", "layer", "protected", "bitrate", "rate", "mono", "size", "samples", "side")
    known: dict[bytes, Header | None] = {}

    @classmethod
    def of(cls, raw: bytes) -> Header | None:
        if raw not in cls.known:
            if len(cls.known) > 100_000:
                cls.known.clear()
            cls.known[raw] = cls._parse(raw)
        return cls.known[raw]

    @classmethod
    def _parse(cls, raw: bytes) -> Header | None:
        if len(raw) < 4 or raw[0] != 0xFF or raw[1] & 0xE0 != 0xE0:
            return None
        version, layer = raw[1] >> 3 & 3, 4 - (raw[1] >> 1 & 3)
        rate_at, bits_at = raw[2] >> 2 & 3, raw[2] >> 4
        if version == 1 or layer == 4 or rate_at == 3 or bits_at in (0, 15):
            return None
        out = cls()
        out.version, out.layer, out.protected, out.mono = version, layer, not raw[1] & 1, raw[3] >> 6 == 3
        out.bitrate, out.rate = _BITRATES[version == 3, layer][bits_at], _RATES[version][rate_at]
        out.samples = 384 if layer == 1 else 1152 if layer == 2 or version == 3 else 576
        padding = raw[2] >> 1 & 1
        out.size = (12000 * out.bitrate // out.rate + padding) * 4 if layer == 1 else out.samples * 125 * out.bitrate // out.rate + padding
        out.side = 0 if layer != 3 else (17 if out.mono else 32) if version == 3 else (9 if out.mono else 17)
        return out

    def fits(self, other: Header) -> bool:
        return (self.version, self.layer, self.rate) == (other.version, other.layer, other.rate)


def _synchsafe(n: int) -> bytes:
    return bytes(n >> shift & 0x7F for shift in (21, 14, 7, 0))


def _header(index: int) -> bytes:
    return bytes((0xFF, 0xFA, index << 4 | 1 << 2, 0))


_PREFIX = {units: _header(k) + struct.pack(">H", crc16(_header(k)[2:] + bytes(32))) + bytes(32) for units, k in _FRAMES.items()}
_SIZE = {units: Header.of(_header(k)).size for units, k in _FRAMES.items()}


def write_stream(payload: bytes) -> bytes:
    """The stream that holds a payload of whole units."""
    if len(payload) % UNIT:
        raise ValueError(f"the payload must be a multiple of {UNIT} bytes")
    units, frames, at = len(payload) // UNIT, [], 0
    while at < units:
        n = min(4, units - at)
        frames.append((_PREFIX[n] + payload[at * UNIT : (at + n) * UNIT]).ljust(_SIZE[n], b"\0"))
        at += n
    size = sum(map(len, frames)) + _SIZE[2]
    ends = [_SIZE[2] + sum(map(len, frames[: len(frames) * k // 100])) for k in range(100)] if len(frames) < 100 else None
    if ends is None:  # all frames but the last have one size
        ends = [_SIZE[2] + _SIZE[4] * (len(frames) * k // 100) for k in range(100)]
    table = b"Xing" + struct.pack(">III", 7, len(frames), size) + bytes(min(255, 256 * e // size) for e in ends)
    text = b"\x03payload\0" + str(len(payload)).encode()
    frame = b"TXXX" + _synchsafe(len(text)) + b"\0\0" + text
    tag = b"ID3\x04\0\0" + _synchsafe(len(frame)) + frame
    return tag + (_PREFIX[2] + table).ljust(_SIZE[2], b"\0") + b"".join(frames)


def _tags(raw: bytes) -> tuple[dict[str, str], int, int]:
    """Text tags, where audio may begin and where it ends."""
    tags, start, end = {}, 0, len(raw)
    if raw[:3] == b"ID3" and len(raw) >= 10 and not any(b & 0x80 for b in raw[6:10]):
        size = raw[6] << 21 | raw[7] << 14 | raw[8] << 7 | raw[9]
        start, at = min(end, 10 + size + 10 * bool(raw[5] & 0x10)), 0
        spread = lambda b: b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]
        held = raw[10 : min(end, 10 + size)]
        if raw[5] & 0x80 and raw[3] < 4:  # a zero stands after each FF
            held = held.replace(b"\xff\0", b"\xff")
        if raw[5] & 0x40 and len(held) >= 4:  # extended header
            at = spread(held) if raw[3] >= 4 else 4 + int.from_bytes(held[:4], "big")
        while at + 10 <= len(held) and held[at : at + 4].strip(b"\0"):
            name, part = held[at : at + 4].decode("latin-1"), held[at + 4 : at + 8]
            length = spread(part) if raw[3] >= 4 else int.from_bytes(part, "big")
            body = held[at + 10 : at + 10 + length]
            if raw[3] >= 4 and held[at + 9] & 2:  # this frame alone is written so
                body = body.replace(b"\xff\0", b"\xff")
            if name[0] == "T" and body:
                kind = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1")
                parts = body[1:].decode(kind, "replace").rstrip("\0").split("\0")
                tags[":".join([name, parts[0]]) if name == "TXXX" and len(parts) > 1 else name] = parts[-1]
            at += 10 + length
    if end - start >= 128 and raw[end - 128 : end - 125] == b"TAG":
        end -= 128
        for name, a, b in (("TIT2", 3, 33), ("TPE1", 33, 63), ("TALB", 63, 93), ("TDRC", 93, 97)):
            if text := raw[end + a : end + b].split(b"\0")[0].decode("latin-1").strip():
                tags.setdefault(name, text)
    return tags, start, end


def read_stream(raw: bytes) -> dict:
    """Everything that :func:`parse` stores of one stream, and the ancillary payload of its frames."""
    tags, at, end = _tags(raw)
    offsets, bodies, skipped, resyncs, bad, checked, samples, bits = [], [], 0, 0, 0, 0, 0, set()
    first, table, synced = None, None, True
    while at + 4 <= end:
        head = Header.of(raw[at : at + 4])
        ok = head is not None and at + head.size <= end and (first is None or first.fits(head))
        if ok and at + head.size + 4 <= end and (not synced or first is None):
            after = Header.of(raw[at + head.size : at + head.size + 4])
            ok = after is not None and after.fits(head)
        if not ok:
            found = raw.find(b"\xff", at + 1, end)
            found = end if found < 0 else found
            resyncs += synced and bool(offsets)
            synced, skipped, at = False, skipped + found - at, found
            continue
        lead = 4 + 2 * head.protected + head.side
        if head.protected and head.layer != 2:
            checked += 1
            covered = lead if head.layer == 3 else 6 + allocation_bits(raw[at + 3]) // 8
            bad += crc16_of(raw[at + 2 : at + 4] + raw[at + 6 : at + covered]) != int.from_bytes(raw[at + 4 : at + 6], "big")
        body = raw[at + lead : at + head.size]
        if first is None and head.layer == 3 and body[:4] in (b"Xing", b"Info") and len(body) >= 8:
            flags, values, place = int.from_bytes(body[4:8], "big"), {}, 8
            for bit, name, width in ((1, "frames", 4), (2, "bytes", 4), (4, "toc", 100)):
                if flags & bit:
                    part = body[place : place + width]
                    values[name] = list(part) if name == "toc" else int.from_bytes(part, "big")
                    place += width
            table = values
        elif first is None and head.layer == 3 and head.size >= 62 and raw[at + 36 : at + 40] == b"VBRI":
            entries, scale, width = struct.unpack(">HHH", raw[at + 54 : at + 60])
            places = range(at + 62, min(at + 62 + entries * width, at + head.size - width + 1), width) if width else ()
            table = {"bytes": int.from_bytes(raw[at + 46 : at + 50], "big"), "frames": int.from_bytes(raw[at + 50 : at + 54], "big"), "toc": [min(scale * int.from_bytes(raw[k : k + width], "big"), 2**31 - 1) for k in places]}
        else:
            offsets.append(at)
            samples += head.samples
            bits.add(head.bitrate)
            bodies.append((head.size, body))
        first, synced = first or head, True
        at += head.size
    return {
        "tags": tags, "version": {3: "1", 2: "2", 0: "2.5"}[first.version] if first else None, "layer": first.layer if first else None, "sample_rate": first.rate if first else None,
        "channels": (1 if first.mono else 2) if first else None, "frames": len(offsets), "samples": samples, "bitrates": sorted(bits), "vbr_frames": table.get("frames") if table else None, "vbr_bytes": table.get("bytes") if table else None,
        "toc": table.get("toc") if table else None, "checked": checked, "bad_checksums": bad, "resyncs": resyncs, "skipped_bytes": skipped + max(0, end - at), "seek": offsets, "bodies": bodies,
    }


_SEEN: dict[bytes, int] = {}


def crc16_of(data: bytes) -> int:
    """:func:`crc16`, remembered: silent frames share their side information."""
    if data not in _SEEN:
        if len(_SEEN) > 10_000:
            _SEEN.clear()
        _SEEN[data] = crc16(data)
    return _SEEN[data]


def allocation_bits(mode: int) -> int:
    """Bits of allocation that a layer I frame protects, by the last byte of its header."""
    kind, bound = mode >> 6, 4 * ((mode >> 4 & 3) + 1)
    return 4 * {0: 64, 1: 32 + bound, 2: 64, 3: 32}[kind]


def payload_of(found: dict) -> bytes:
    """The bytes that :func:`write_stream` was given."""
    units = {size: n for n, size in _SIZE.items()}
    return b"".join(body[: units.get(size, 0) * UNIT] for size, body in found["bodies"])


_INT, _LONG, _TEXT = T.IntegerType(), T.LongType(), T.StringType()
#: What :func:`parse` stores of a stream.
READ = T.StructType(
    [T.StructField("tags", T.MapType(_TEXT, _TEXT)), T.StructField("version", _TEXT)]
    + [T.StructField(n, _INT) for n in ("layer", "sample_rate", "channels", "frames")]
    + [T.StructField("samples", _LONG), T.StructField("bitrates", T.ArrayType(_INT)), T.StructField("vbr_frames", _LONG), T.StructField("vbr_bytes", _LONG), T.StructField("toc", T.ArrayType(_INT))]
    + [T.StructField(n, _INT) for n in ("checked", "bad_checksums", "resyncs")]
    + [T.StructField("skipped_bytes", _LONG), T.StructField("seek", T.ArrayType(_LONG))]
)


def _map(df: DataFrame, work, names: dict[str, T.DataType]) -> DataFrame:
    """``df`` with columns that ``work`` makes of one Arrow batch."""
    out = df.drop(*names)
    schema = T.StructType([*out.schema.fields, *(T.StructField(k, v) for k, v in names.items())])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                made = work(batch)
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *names])

    return out.mapInArrow(run, schema)


def write(df: DataFrame, payload_col: str = "payload", media_col: str = "media") -> DataFrame:
    """``df`` with the stream of each payload (null stays null)."""

    def work(batch):
        return [pa.array([None if p is None else write_stream(p) for p in batch.column(payload_col).to_pylist()], pa.binary())]

    return _map(df, work, {media_col: T.BinaryType()})


def parse(df: DataFrame, media_col: str = "media", into: str = "audio", payload_col: str | None = None) -> DataFrame:
    """``df`` with a struct of what is in each stream, and its ancillary payload if a name is given."""
    fields = [(f.name, f.dataType) for f in READ.fields]
    names = {into: READ} | ({payload_col: T.BinaryType()} if payload_col else {})
    arrow = pa.struct([("tags", pa.map_(pa.string(), pa.string())), ("version", pa.string()), *((n, pa.int32()) for n in ("layer", "sample_rate", "channels", "frames")), ("samples", pa.int64()), ("bitrates", pa.list_(pa.int32())), ("vbr_frames", pa.int64()), ("vbr_bytes", pa.int64()), ("toc", pa.list_(pa.int32())), *((n, pa.int32()) for n in ("checked", "bad_checksums", "resyncs")), ("skipped_bytes", pa.int64()), ("seek", pa.list_(pa.int64()))])

    def work(batch):
        found = [None if m is None else read_stream(m) for m in batch.column(media_col).to_pylist()]
        rows = [None if x is None else {n: list(x[n].items()) if n == "tags" else x[n] for n, _ in fields} for x in found]
        return [pa.array(rows, arrow), *([pa.array([None if x is None else payload_of(x) for x in found], pa.binary())] if payload_col else [])]

    return _map(df, work, names)


def padded(text_col: str = "text"):
    """Payload of a text: its bytes, then blanks up to a positive multiple of the unit."""
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    short = F.when(F.length(raw) == 0, UNIT).otherwise(F.pmod(-F.length(raw), F.lit(UNIT)))
    return F.concat(raw, F.repeat(F.lit(" "), short.cast("int")).cast("binary"))


def op3_audio(spark, sf_dir: str) -> DataFrame:
    """Contract digest: each text as a stream, read back from the stored bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_bytes"), padded().alias("payload"))
    read = parse(write(docs).drop("payload"), payload_col="back")
    audio = F.col("audio")
    duration = audio["samples"].cast("double") / audio["sample_rate"]
    return read.select(
        "doc_id",
        "n_bytes",
        F.length("back").cast("bigint").alias("payload_bytes"),
        F.sha2("back", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(back, greatest(length(back) - 15, 1), 16)")).alias("tail_crc32"),
        F.length("media").cast("bigint").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(";", F.concat(F.lit("mpeg"), audio["version"]), F.concat(F.lit("layer"), audio["layer"]), audio["sample_rate"], F.concat_ws("/", audio["bitrates"].cast("array<string>")), audio["frames"], audio["samples"], F.format_string("%.6f", duration), audio["bad_checksums"], audio["resyncs"], F.element_at(audio["seek"], -1)).alias("feature"),
    )
