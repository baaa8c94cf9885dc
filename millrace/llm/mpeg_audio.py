"""Media columns: MPEG audio.

`probe` reads any MPEG-1/2/2.5 stream of layers I to III: it skips and parses ID3 tags, finds frame
headers again after damage, reads Xing, Info and VBRI tables, verifies the checksums of protected
layer III frames, and gives the exact duration (samples over sample rate) and the place of every frame.
`pack` stores bytes as silent layer III frames with 192 bytes each in the ancillary data, behind an
ID3v2 tag and an Info table.

Defined results: null media counts as empty and has no frames; what isn't a frame counts as skipped
bytes; a stream cut inside a frame ends before it; null text counts as empty; an empty table gives an
empty result; repeated rows give repeated rows; a very long text is one stream, with an offset a frame; other
columns are kept by `probe`. `mpeg_audio` fails where a payload isn't read back whole.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.shared import in_batches

# Fixed values of the format (kbit/s by version group and layer, index 1 to 14; Hz by version).
BITRATES = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {1: (44100, 48000, 32000), 2: (22050, 24000, 16000), 2.5: (11025, 12000, 8000)}
POLYNOMIAL, CRC_START = 0x8005, 0xFFFF

#: Bytes of payload in a frame.
UNIT = 192
#: MPEG-1 layer III with checksum, 80 kbit/s, 48 kHz, mono: 240 bytes a frame.
HEADER = bytes((0xFF, 0xFA, 0x64, 0xC0))
FRAME, SIDE, SAMPLES, RATE = 240, 17, 1152, 48000


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        table = np.where(table & 0x8000, (table << 1) ^ POLYNOMIAL, table << 1) & 0xFFFF
    return table


_CRC = _crc_table()


def crc16(rows: np.ndarray) -> np.ndarray:
    """The checksum of each row of bytes."""
    crc = np.full(len(rows), CRC_START, np.uint32)
    for j in range(rows.shape[1]):
        crc = ((crc << 8) & 0xFFFF) ^ _CRC[(crc >> 8) ^ rows[:, j]]
    return crc


def header(word: bytes) -> tuple | None:
    """(version, layer, protected, bytes, samples, rate, channels, side bytes) of a frame header, or None."""
    if len(word) < 4 or word[0] != 0xFF or word[1] < 0xE0:
        return None
    version = (2.5, None, 2, 1)[word[1] >> 3 & 3]
    layer, bits, rate = 4 - (word[1] >> 1 & 3), word[2] >> 4, word[2] >> 2 & 3
    if version is None or layer == 4 or bits in (0, 15) or rate == 3:
        return None
    rate = RATES[version][rate]
    bits = BITRATES[1 if version == 1 else 2, layer][bits - 1] * 1000
    pad, mono = word[2] >> 1 & 1, word[3] >> 6 == 3
    samples = 384 if layer == 1 else 1152 if layer == 2 or version == 1 else 576
    size = (12 * bits // rate + pad) * 4 if layer == 1 else samples // 8 * bits // rate + pad
    side = 0 if layer != 3 else (17 if mono else 32) if version == 1 else (9 if mono else 17)
    return version, layer, not word[1] & 1, size, samples, rate, 1 if mono else 2, side


def _tags(data: bytes) -> tuple[dict, int]:
    """Text frames of leading ID3v2 tags, and where the audio begins."""
    tags, begin, end = {}, 0, len(data)
    while data[begin : begin + 3] == b"ID3" and begin + 10 <= end:
        n = 0
        for b in data[begin + 6 : begin + 10]:
            n = n << 7 | b & 127
        at, stop, wide = begin + 10, min(begin + 10 + n, end), data[begin + 3] >= 4
        while at + 10 <= stop and data[at : at + 4].isalnum():
            size = 0
            for b in data[at + 4 : at + 8]:
                size = size << 7 | b & 127 if wide else size << 8 | b
            if data[at : at + 1] == b"T" and size:
                body = data[at + 11 : min(at + 10 + size, stop)]
                coding = ("latin-1", "utf-16", "utf-16-be", "utf-8")[data[at + 10]] if data[at + 10] < 4 else "latin-1"
                tags[data[at : at + 4].decode("latin-1")] = body.decode(coding, "replace").rstrip("\0").replace("\0", "=")
            at += 10 + size
        begin = begin + 10 + n + (10 if data[begin + 5] & 16 else 0)
    return tags, min(begin, end)


def _last_tag(tag: bytes) -> dict:
    """Text fields of a trailing ID3v1 tag."""
    fields = (("TIT2", 3, 33), ("TPE1", 33, 63), ("TALB", 63, 93))
    return {name: text for name, a, b in fields if (text := tag[a:b].rstrip(b"\0 ").decode("latin-1"))}


def _table(frame: bytes, side: int, protected: bool) -> dict | None:
    """The Xing, Info or VBRI table in a first frame."""
    for at in (4 + side + (2 if protected else 0), 4 + side):
        kind = frame[at : at + 4]
        if kind in (b"Xing", b"Info") and len(frame) >= at + 8:
            flags, at, out = struct.unpack(">I", frame[at + 4 : at + 8])[0], at + 8, {"kind": kind.decode()}
            for bit, name in ((1, "frames"), (2, "bytes")):
                if flags & bit and len(frame) >= at + 4:
                    out[name], at = struct.unpack(">I", frame[at : at + 4])[0], at + 4
            if flags & 4:
                out["toc"] = frame[at : at + 100]
            return out
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        size, count = struct.unpack(">II", frame[46:54])
        return {"kind": "VBRI", "frames": count, "bytes": size, "toc": b""}
    return None


def parse(data: bytes) -> dict:
    """Tags, table, frame places, samples, checksums and skipped bytes of a stream.

    What looks like a trailing ID3v1 tag is one only where frames don't run through it to the end.
    """
    tags, begin = _tags(data)
    found, through = _frames(data, begin, len(data), tags)
    last = len(data) - 128
    if last >= begin and data[last : last + 3] == b"TAG" and not through:
        tags = _last_tag(data[last:]) | tags
        found, _ = _frames(data, begin, last, tags)
    return found


def _frames(data: bytes, at: int, end: int, tags: dict) -> tuple[dict, bool]:
    """What a stream holds from at to end, and whether frames in step cover its last 128 bytes."""
    raw, through = np.frombuffer(data, np.uint8), True
    starts, table, first, synced, skipped, good, bad, samples, rates = [], None, True, False, 0, 0, 0, 0, {}
    own, payload, form = tags.get("TXXX", "").startswith("payload="), [], None
    while at + 4 <= end:
        head = header(data[at : at + 4])
        size = head[3] if head else 0
        follows = at + size
        if not head or follows > end or not (synced or follows + 4 > end or header(data[follows : follows + 4])):
            # Out of step: the next sync byte is tried, and a frame must be followed by another or the end.
            nxt = data.find(b"\xff", at + 1, end)
            nxt = end if nxt < 0 else nxt
            through &= nxt <= end - 128
            skipped, at, synced = skipped + nxt - at, nxt, False
            continue
        synced = True
        version, layer, protected, size, each, rate, channels, side = head
        if first:
            first = False
            table = _table(data[at : at + size], side, protected)
            if table:
                at += size
                continue
        # As many frames as repeat this header at this distance are taken together.
        n = (end - at) // size
        block = raw[at : at + n * size].reshape(n, size)
        same = (block[:, :4] == raw[at : at + 4]).all(1)
        n = n if same.all() else int(np.argmin(same))
        block = block[:n]
        if protected and layer == 3 and size >= 6 + side:
            right = crc16(block[:, [2, 3, *range(6, 6 + side)]]) == (block[:, 4].astype(np.uint32) << 8 | block[:, 5])
            good, bad = good + int(right.sum()), bad + int((~right).sum())
        starts.append(at + np.arange(n, dtype=np.int64) * size)
        body = (6 if protected else 4) + side
        if own and size >= body + UNIT:
            payload.append(block[:, body : body + UNIT].tobytes())
        samples += n * each
        rates[rate] = rates.get(rate, 0) + n * each
        form, at = f"mpeg{version}-layer{layer}-{rate}Hz-{channels}ch", at + n * size
    skipped += max(0, end - at)
    starts = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    seconds = sum(n / r for r, n in rates.items())
    return {
        "form": form, "frames": len(starts), "samples": samples, "seconds": seconds, "good": good, "bad": bad, "skipped": skipped,
        "table": table["kind"] if table else None, "table_frames": table.get("frames") if table else None, "tags": tags, "starts": starts, "payload": b"".join(payload),
    }, through and at == end


def _id3(frames: dict[str, str]) -> bytes:
    safe = lambda n: bytes((n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127))
    body = b"".join(k.encode() + safe(len(v) + 1) + b"\0\0\3" + v.encode() for k, v in frames.items())
    return b"ID3\4\0\0" + safe(len(body)) + body


def pack(text: bytes) -> bytes:
    """text, padded with spaces to a positive multiple of UNIT, as a stream."""
    text = text + b" " * (-len(text) % UNIT if text else UNIT)
    n = len(text) // UNIT
    block = np.zeros((n, FRAME), np.uint8)
    block[:, :4] = np.frombuffer(HEADER, np.uint8)
    crc = int(crc16(np.array([[*HEADER[2:], *bytes(SIDE)]], np.uint8))[0])
    block[:, 4], block[:, 5] = crc >> 8, crc & 255
    block[:, 6 + SIDE : 6 + SIDE + UNIT] = np.frombuffer(text, np.uint8).reshape(n, UNIT)
    toc = bytes(min(255, 256 * i // 100) for i in range(100))
    info = (HEADER[:1] + b"\xfb" + HEADER[2:] + bytes(SIDE) + b"Info" + struct.pack(">III", 7, n, (n + 1) * FRAME) + toc).ljust(FRAME, b"\0")
    return _id3({"TLEN": str(n * SAMPLES * 1000 // RATE), "TXXX": f"payload\0{len(text)}"}) + info + block.tobytes()


def _packed(batches):
    for b in batches:
        media = [pack(x or b"") for x in b.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, the bytes of its text and the media that stores it."""
    docs = in_batches(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("n_bytes", F.octet_length("text").cast("long"))
    return docs.mapInArrow(_packed, docs.select("doc_id", "n_bytes").schema.add("media", "binary"))


PROBED = T.StructType().add("form", "string").add("frames", "long").add("samples", "long").add("duration_s", "double").add("crc_good", "long").add("crc_bad", "long").add("skipped", "long").add("vbr_table", "string").add("table_frames", "long").add("tags", T.MapType(T.StringType(), T.StringType())).add("frame_offsets", T.ArrayType(T.LongType())).add("payload", "binary")


def _probed(column: str):
    def run(batches):
        for b in batches:
            at = b.schema.get_field_index(column)
            found = [parse(x or b"") for x in b.column(at).to_pylist()]
            cols = ("form", "frames", "samples", "seconds", "good", "bad", "skipped", "table", "table_frames")
            types = (pa.string(), *[pa.int64()] * 2, pa.float64(), *[pa.int64()] * 3, pa.string(), pa.int64())
            out = [pa.array([x[c] for x in found], t) for c, t in zip(cols, types)]
            out.append(pa.array([list(x["tags"].items()) for x in found], pa.map_(pa.string(), pa.string())))
            out.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x["starts"]) for x in found])]), pa.int32()), pa.array(np.concatenate([x["starts"] for x in found] or [np.zeros(0, np.int64)]))))
            out.append(pa.array([x["payload"] for x in found], pa.binary()))
            yield pa.RecordBatch.from_arrays([*b.columns, *out], [*b.schema.names, *PROBED.names])

    return run


def probe(media: DataFrame, column: str = "media") -> DataFrame:
    """media with what its stream holds."""
    return in_batches(media).mapInArrow(_probed(column), T.StructType([*media.schema.fields, *PROBED.fields]))


def mpeg_audio(docs: DataFrame) -> DataFrame:
    read = probe(packed(docs))
    offsets = F.sha2(F.array_join("frame_offsets", ",").cast("binary"), 256)
    feature = F.concat_ws(";", "form", F.concat(F.lit("frames="), "frames"), F.concat(F.lit("duration="), "samples", F.lit(f"/{RATE}")), F.concat(F.lit("crc="), "crc_good", F.lit("/"), F.col("crc_good") + F.col("crc_bad")), F.concat(F.lit("table="), "vbr_table", F.lit(":"), "table_frames"), F.concat(F.lit("skipped="), "skipped"), F.concat(F.lit("tlen="), F.col("tags")["TLEN"]), F.concat(F.lit("seek="), F.substring(offsets, 1, 16)))
    stored = F.regexp_extract(F.col("tags")["TXXX"], r"(\d+)$", 1).cast("long")
    # What is read back must be all that was stored: a loss is an error, never a row.
    whole = F.coalesce(stored == F.length("payload"), F.lit(False))
    read = read.withColumn("payload", F.when(whole, F.col("payload")).otherwise(F.raise_error(F.lit("a payload was not read back whole")).cast("binary")))
    return read.select(
        "doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"), F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"),
        "duration_s", "frame_offsets",
    )

