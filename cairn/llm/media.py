"""Matroska columns: write payloads as audio packets, parse files into packet and cue tables.

Files are trees of EBML elements: an id and a size, both integers of variable
length, and a body. The parser walks them without copying and gives every
packet's track, timestamp, byte range, cluster and lacing; elements it doesn't
know are skipped, sizes may be unknown (live streams), and blocks may be laced
in all three ways. The writer stores bytes as unsigned 8-bit PCM in clusters of
laced blocks, with cues.

Packets of tracks with stripped headers get them back; packets that are
compressed or encrypted otherwise are listed as stored, and ``error`` says so.

Cases: a null or empty text is a payload of blanks; very long texts are files of
many clusters; a null, cut off or foreign file has no packets beyond the damage
and says so in ``error``; equal payloads give equal files, rows that repeat a
doc_id have a file each; an empty table gives no rows; other columns, whatever
their names, are not read.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.shared import id_text, map_rows

#: Element ids.
EBML, SEGMENT, INFO, SCALE, TRACKS, ENTRY, CLUSTER, TIME, SIMPLE, GROUP, BLOCK, REFERENCE, CUES, POINT = (
    0x1A45DFA3, 0x18538067, 0x1549A966, 0x2AD7B1, 0x1654AE6B, 0xAE, 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB, 0x1C53BB6B, 0xBB,
)
NUMBER, UID, KIND, CODEC, AUDIO, RATE, CHANNELS, DEPTH, CUE_TIME, CUE_PLACE, CUE_TRACK, CUE_CLUSTER, DOC_TYPE, DEFAULT = (
    0xD7, 0x73C5, 0x83, 0x86, 0xE1, 0xB5, 0x9F, 0x6264, 0xB3, 0xB7, 0xF7, 0xF1, 0x4282, 0x23E383,
)
ENCODINGS, ENCODING, ENCODING_KIND, COMPRESSION, ALGORITHM, STRIPPED, ENCRYPTION = 0x6D80, 0x6240, 0x5033, 0x5034, 0x4254, 0x4255, 0x5035
EBML_VERSION, READ_VERSION, ID_LENGTH, SIZE_LENGTH, DOC_VERSION, DOC_READ_VERSION, MUXING, WRITING = 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4287, 0x4285, 0x4D80, 0x5741
INSIDE = {SEGMENT, INFO, TRACKS, ENTRY, CLUSTER, GROUP, CUES, POINT, CUE_PLACE, ENCODINGS, ENCODING, COMPRESSION}
LACING = ("none", "xiph", "fixed", "ebml")
#: The writer's: samples a second, bytes of a packet, packets of a block, blocks of a cluster.
HERTZ, PACKET, LACED, BLOCKS, UNIT = 8000, 1920, 8, 16, 192


class Packet(NamedTuple):
    cluster: int
    track: int
    timestamp_ns: int
    keyframe: bool
    lacing: str
    offset: int
    size: int


# ---- reading


def number(data: bytes, at: int, mark: bool) -> tuple[int, int]:
    """Variable-length integer and the place after it; mark: keep the length bit, as ids do. -1: unknown size."""
    first = data[at]
    n = 9 - first.bit_length()
    if n > 8 or at + n > len(data):
        raise ValueError(f"no number at byte {at}")
    value = int.from_bytes(data[at : at + n], "big")
    if not mark:
        full = (1 << 7 * n) - 1
        value = -1 if value & full == full else value & full
    return value, at + n


def lace_sizes(data: bytes, at: int, end: int, kind: int) -> tuple[list[int], int]:
    """Sizes of a block's packets and the place of the first."""
    if kind == 0:
        return [end - at], at
    n = data[at] + 1
    at += 1
    if kind == 2:
        if (end - at) % n:
            raise ValueError(f"uneven lace at byte {at}")
        return [(end - at) // n] * n, at
    sizes: list[int] = []
    if kind == 1:
        for _ in range(n - 1):
            size = 0
            while (b := data[at]) == 255:
                size, at = size + 255, at + 1
            sizes.append(size + b)
            at += 1
    elif n > 1:
        size, at = number(data, at, False)
        sizes.append(size)
        for _ in range(n - 2):
            start = at
            step, at = number(data, at, False)
            if step < 0:  # all value bits set: the largest step
                step = (1 << 7 * (at - start)) - 1
            sizes.append(sizes[-1] + step - ((1 << (7 * (at - start) - 1)) - 1))
    if at + sum(sizes) > end or min(sizes, default=0) < 0:
        raise ValueError(f"lace beyond its block at byte {at}")
    return [*sizes, end - at - sum(sizes)], at


class Parsed:
    """packets, cues (time_ns, track, byte of the cluster), tracks (number to codec) and error of a file."""

    def __init__(self, data: bytes | None):
        self.packets: list[Packet] = []
        self.cues: list[tuple[int, int, int]] = []
        self.tracks: dict[int, str] = {}
        self.durations: dict[int, int] = {}  # of a packet in ns, which sets laced packets apart
        self.prefix: dict[int, bytes] = {}  # what was stripped off each packet of a track
        self.encodings: list[dict] = []  # of the track being read
        self.scale, self.clusters, self.base, self.time, self.error = 1_000_000, 0, 0, 0, None
        try:
            if not data or number(data, 0, True)[0] != EBML:
                raise ValueError("no EBML header")
            self.walk(data, 0, len(data), 0)
        except (ValueError, IndexError) as e:
            self.error = str(e)

    def payload(self, data: bytes) -> bytes:
        """The packets' byte ranges, joined, with stripped headers before each."""
        return b"".join(self.prefix.get(q.track, b"") + data[q.offset : q.offset + q.size] for q in self.packets)

    def encoded(self, track: int) -> None:
        """Take down how a track's packets are stored."""
        for e in self.encodings:
            if e.get(ENCODING_KIND, 0) == 0 and e.get(ALGORITHM, 0) == 3 and len(self.encodings) == 1:
                self.prefix[track] = e.get(STRIPPED, b"")
            else:
                self.error = f"packets of track {track} are {'encrypted' if e.get(ENCODING_KIND, 0) else 'compressed'}"

    def walk(self, data: bytes, at: int, end: int, parent: int) -> int:
        entry: dict = {}
        cue = [0, 0, 0]
        while at < end:
            start = at
            kind, at = number(data, at, True)
            if parent == CLUSTER and kind in (CLUSTER, CUES) or parent == SEGMENT and kind == EBML:
                return start  # ends an element of unknown size
            size, body = number(data, at, False)
            stop = end if size < 0 else body + size
            if stop > end:
                raise ValueError(f"element beyond its parent at byte {start}")
            value = lambda a=body, b=stop: int.from_bytes(data[a:b], "big")
            if kind == SEGMENT:
                self.base = body
            if kind == ENTRY:
                self.encodings = []
            elif kind == ENCODING:
                self.encodings.append({})
            if kind == CLUSTER:
                self.clusters += 1
                self.time = 0
            if kind in INSIDE:
                done = self.walk(data, body, stop, kind)
                if isinstance(done, tuple):
                    cue[1:] = done
                elif size < 0:
                    stop = done
            elif kind == SCALE:
                self.scale = value()
            elif kind == TIME:
                self.time = value()
            elif kind in (NUMBER, DEFAULT):
                entry[kind] = value()
            elif kind in (ENCODING_KIND, ALGORITHM, STRIPPED) and self.encodings:
                self.encodings[-1][kind] = data[body:stop] if kind == STRIPPED else value()
            elif kind == ENCRYPTION and self.encodings:
                self.encodings[-1][ENCODING_KIND] = 1
            elif kind == CODEC:
                entry[kind] = data[body:stop].decode("ascii", "replace")
            elif kind == SIMPLE:
                self.block(data, body, stop, None)
            elif kind == BLOCK:
                entry[BLOCK] = (body, stop)
            elif kind == REFERENCE:
                entry[REFERENCE] = True
            elif kind in (CUE_TIME, CUE_TRACK, CUE_CLUSTER):
                cue[(CUE_TIME, CUE_TRACK, CUE_CLUSTER).index(kind)] = value()
            at = stop
        if parent == ENTRY:
            self.tracks[entry.get(NUMBER, 0)] = entry.get(CODEC, "")
            self.durations[entry.get(NUMBER, 0)] = entry.get(DEFAULT, 0)
            self.encoded(entry.get(NUMBER, 0))
        elif parent == GROUP and BLOCK in entry:
            self.block(data, *entry[BLOCK], REFERENCE not in entry)
        elif parent == CUE_PLACE:
            return cue[1], cue[2]
        elif parent == POINT:
            self.cues.append((cue[0] * self.scale, cue[1], self.base + cue[2]))
        return at

    def block(self, data: bytes, at: int, end: int, key: bool | None) -> None:
        track, at = number(data, at, False)
        time = self.time + int.from_bytes(data[at : at + 2], "big", signed=True)
        flags = data[at + 2]
        lacing = flags >> 1 & 3
        sizes, at = lace_sizes(data, at + 3, end, lacing)
        for k, size in enumerate(sizes):
            self.packets.append(Packet(self.clusters - 1, track, time * self.scale + k * self.durations.get(track, 0), bool(flags & 128) if key is None else key, LACING[lacing], at, size))
            at += size


# ---- writing


def sized(n: int, least: int = 1) -> bytes:
    k = least
    while n >= (1 << 7 * k) - 1:
        k += 1
    return (n | 1 << 7 * k).to_bytes(k, "big")


def element(kind: int, body: bytes | int | str) -> bytes:
    if isinstance(body, int):
        body = body.to_bytes(max(1, -(-body.bit_length() // 8)), "big")
    elif isinstance(body, str):
        body = body.encode()
    return kind.to_bytes(-(-kind.bit_length() // 8), "big") + sized(len(body)) + body


def laced_block(packets: list[bytes], time: int, lacing: str) -> bytes:
    """Body of a SimpleBlock of track 1, a key frame."""
    head = sized(1) + time.to_bytes(2, "big", signed=True) + bytes([128 | LACING.index(lacing) << 1])
    if lacing == "none":
        return head + packets[0]
    sizes = [len(p) for p in packets]
    out = bytes([len(sizes) - 1])
    if lacing == "xiph":
        out += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif lacing == "ebml" and len(sizes) > 1:
        out += sized(sizes[0])
        for a, b in zip(sizes, sizes[1:-1], strict=False):
            k = next(k for k in range(1, 9) if abs(b - a) < 1 << (7 * k - 1))
            out += ((b - a + (1 << (7 * k - 1)) - 1) | 1 << 7 * k).to_bytes(k, "big")
    return head + out + b"".join(packets)


def padded(text: bytes) -> bytes:
    """Bytes 32 up to a positive multiple of UNIT."""
    return text + b" " * (-len(text) % UNIT if text else UNIT)


def written(payload: bytes) -> bytes:
    """A file whose packets, joined, are the payload."""
    head = element(EBML, b"".join((element(EBML_VERSION, 1), element(READ_VERSION, 1), element(ID_LENGTH, 4), element(SIZE_LENGTH, 8), element(DOC_TYPE, "matroska"), element(DOC_VERSION, 4), element(DOC_READ_VERSION, 2))))
    audio = element(RATE, np.float64(HERTZ).byteswap().tobytes()) + element(CHANNELS, 1) + element(DEPTH, 8)
    front = element(INFO, element(SCALE, 1_000_000) + element(MUXING, "cairn") + element(WRITING, "cairn")) + element(TRACKS, element(ENTRY, element(NUMBER, 1) + element(UID, 1) + element(KIND, 2) + element(CODEC, "A_PCM/INT/LIT") + element(DEFAULT, PACKET * 1_000_000 // 8) + element(AUDIO, audio)))
    packets = [payload[i : i + PACKET] for i in range(0, len(payload), PACKET)]
    length = 1000 * PACKET // HERTZ
    clusters, cues, place = [], [], len(front)
    for first in range(0, len(packets), LACED * BLOCKS):
        time, blocks = first * length, []
        for i in range(first, min(first + LACED * BLOCKS, len(packets)), LACED):
            group = packets[i : i + LACED]
            lacing = "none" if len(group) == 1 else "fixed" if len(group[-1]) == len(group[0]) else "ebml"
            blocks.append(element(SIMPLE, laced_block(group, i * length - time, lacing)))
        clusters.append(element(CLUSTER, element(TIME, time) + b"".join(blocks)))
        cues.append(element(POINT, element(CUE_TIME, time) + element(CUE_PLACE, element(CUE_TRACK, 1) + element(CUE_CLUSTER, place))))
        place += len(clusters[-1])
    return head + element(SEGMENT, front + b"".join(clusters) + element(CUES, b"".join(cues)))


def feature(parsed: Parsed, payload: bytes) -> str:
    """Counts and integer sample statistics."""
    x = np.frombuffer(payload, np.uint8)
    mean, square = (int(1000 * f) for f in ((x.mean(dtype=np.float64), np.square(x.astype(np.float64)).mean()) if len(x) else (0, 0)))
    crossings = int(np.count_nonzero(np.diff(x < 96)))
    end = max((p.timestamp_ns // 1_000_000 for p in parsed.packets), default=0)
    return f"clusters={parsed.clusters};packets={len(parsed.packets)};cues={len(parsed.cues)};last_ms={end};mean={mean};square={square};crossings={crossings}"


# ---- tables


def write_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media, the text's padded UTF-8 bytes as a file."""

    def make():
        def step(x: dict) -> dict:
            data = [t.encode("utf-8", "surrogatepass") for t in x["text"]]
            return {"doc_id": x["doc_id"], "n_bytes": list(map(len, data)), "media": [written(padded(d)) for d in data]}

        return step

    return map_rows(id_text(docs), make, "doc_id long, n_bytes long, media binary")


def packet_table(files: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """A row for each packet of each file: key, packet, cluster, track, codec, timestamp_ns, keyframe, lacing, offset, size and prefix (a stripped header); one row with ``error`` for damage."""
    fields = "packet long, cluster long, track long, codec string, timestamp_ns long, keyframe boolean, lacing string, offset long, size long, prefix binary, error string"

    def make():
        def step(x: dict) -> dict:
            out = []
            for data in x["media"]:
                p = Parsed(data)
                rows = [{"packet": i, "codec": p.tracks.get(q.track), "prefix": p.prefix.get(q.track), "error": None, **q._asdict()} for i, q in enumerate(p.packets)]
                out.append(rows + [{"error": p.error}] * (p.error is not None))
            return {"key": x["key"], "rows": out}

        return step

    kind = files.schema[key].dataType.simpleString()
    rows = map_rows(files.select(F.col(key).alias("key"), F.col(media).alias("media")), make, f"key {kind}, rows array<struct<{fields.replace(' ', ':').replace(',:', ',')}>>")
    return rows.select(F.col("key").alias(key), F.inline("rows"))


def cue_table(files: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """A row for each cue: key, time_ns, track and position (byte of the cluster in the file)."""

    def make():
        names = ("time_ns", "track", "position")
        return lambda x: {"key": x["key"], "rows": [[dict(zip(names, c, strict=True)) for c in Parsed(data).cues] for data in x["media"]]}

    kind = files.schema[key].dataType.simpleString()
    rows = map_rows(files.select(F.col(key).alias("key"), F.col(media).alias("media")), make, f"key {kind}, rows array<struct<time_ns:long,track:long,position:long>>")
    return rows.select(F.col("key").alias(key), F.inline("rows"))


def read_media(files: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media, payload (the packets' byte ranges, joined), feature and error."""

    def make():
        def step(x: dict) -> dict:
            out = {**x, "payload": [], "feature": [], "error": []}
            for data in x["media"]:
                p = Parsed(data)
                payload = p.payload(data)
                out["payload"].append(payload)
                out["feature"].append(feature(p, payload))
                out["error"].append(p.error)
            return out

        return step

    return map_rows(files.select("doc_id", "n_bytes", "media"), make, "doc_id long, n_bytes long, media binary, payload binary, feature string, error string")


def media_digests(read: DataFrame) -> DataFrame:
    return read.select(
        "doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )
