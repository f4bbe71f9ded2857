import hashlib
import random
import zlib

import pytest

from cairn.llm import media
from cairn.llm.media import BLOCK, CLUSTER, CODEC, DOC_TYPE, EBML, ENTRY, GROUP, INFO, LACING, NUMBER, REFERENCE, SEGMENT, SIMPLE, TIME, TRACKS, Parsed, element, laced_block, sized


def payload_of(data):
    p = Parsed(data)
    assert p.error is None
    return b"".join(data[q.offset : q.offset + q.size] for q in p.packets)


@pytest.mark.parametrize("n", [192, 1920, 1920 * 7, 1920 * 8 + 192, 1920 * 300 + 384])
def test_round_trip(n):
    payload = random.Random(n).randbytes(n)
    data = media.written(payload)
    assert payload_of(data) == payload
    p = Parsed(data)
    assert [q.timestamp_ns for q in p.packets] == [i * 240_000_000 for i in range(len(p.packets))]
    assert len(p.cues) == p.clusters and all(data[place : place + 4] == CLUSTER.to_bytes(4, "big") for _, _, place in p.cues)


def body(blocks):
    track = element(TRACKS, element(ENTRY, element(NUMBER, 1) + element(CODEC, "A_X")))
    return track + element(CLUSTER, element(TIME, 1000) + blocks)


@pytest.mark.parametrize("lacing", LACING)
def test_lacing(lacing):
    rng = random.Random(4)
    sizes = {"none": [700], "fixed": [40] * 5}.get(lacing, [3, 1000, 255, 0, 254, 256, 70000, 20])
    packets = [rng.randbytes(n) for n in sizes]
    data = element(EBML, element(DOC_TYPE, "matroska")) + element(SEGMENT, body(element(SIMPLE, laced_block(packets, -5, lacing))))
    p = Parsed(data)
    assert [data[q.offset : q.offset + q.size] for q in p.packets] == packets
    assert {(q.lacing, q.timestamp_ns, q.track, q.keyframe) for q in p.packets} == {(lacing, 995_000_000, 1, True)}


def test_block_groups_and_unknown_sizes():
    one = element(GROUP, element(BLOCK, laced_block([b"abc"], 1, "none")))
    two = element(GROUP, element(BLOCK, laced_block([b"defg"], 2, "none")) + element(REFERENCE, 1))
    open_size = b"\x01" + b"\xff" * 7
    cluster = CLUSTER.to_bytes(4, "big") + open_size
    data = element(EBML, b"") + SEGMENT.to_bytes(4, "big") + open_size + element(INFO, b"") + cluster + element(TIME, 7) + one + element(0xEC, b"void") + cluster + element(TIME, 9) + two
    p = Parsed(data)
    assert p.error is None and [(q.cluster, q.timestamp_ns, q.keyframe, q.size) for q in p.packets] == [(0, 8_000_000, True, 3), (1, 11_000_000, False, 4)]


def test_numbers():
    for n in (0, 1, 126, 127, 128, 16382, 16383, 1 << 30):
        assert media.number(sized(n), 0, False) == (n, len(sized(n)))


def test_damage():
    data = media.written(bytes(192 * 100))
    for bad in (None, b"", b"RIFF....", data[:-1], data[: len(data) // 2]):
        assert Parsed(bad).error
    rng = random.Random(1)
    for _ in range(300):
        torn = bytearray(data)
        torn[rng.randrange(len(torn))] = rng.randrange(256)
        Parsed(bytes(torn))


def test_tables(spark):
    texts = ["", None, "x" * 192, "é" * 5000, "abc " * 60000]
    docs = spark.createDataFrame([(i, t, b"") for i, t in enumerate(texts)], "doc_id long, text string, media binary")
    files = media.write_media(docs)
    got = {r.doc_id: r for r in media.media_digests(media.read_media(files)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        want = raw + b" " * (-len(raw) % 192 if raw else 192)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-16:]))
        assert r.media_sha256 == hashlib.sha256(media.written(want)).hexdigest() and r.media_bytes == len(media.written(want))
    assert got[0].feature == got[1].feature
    packets = media.packet_table(files.union(spark.createDataFrame([(9, 0, None)], files.schema))).toPandas()
    assert packets[packets.doc_id == 9].error.tolist() == ["no EBML header"] and (packets[packets.doc_id == 4]["size"].sum()) == 240000
    assert media.cue_table(files).where("doc_id = 4").count() == 1
    assert media.read_media(files.limit(0)).count() == 0 and media.write_media(docs.limit(0)).count() == 0
    twice = media.media_digests(media.read_media(media.write_media(docs.union(docs)))).toPandas()
    assert (twice.groupby("doc_id").size() == 2).all() and (twice.groupby("doc_id").media_sha256.nunique() == 1).all()


def test_header_names_what_readers_need():
    data = media.written(b"x" * 192)
    assert element(media.DOC_VERSION, 4) in data[:64] and element(media.DOC_READ_VERSION, 2) in data[:64] and element(DOC_TYPE, "matroska") in data[:64]
    assert element(media.MUXING, "cairn") in data and element(media.WRITING, "cairn") in data


def encoded(*encodings):
    track = element(TRACKS, element(ENTRY, element(NUMBER, 1) + element(CODEC, "A_X") + element(media.ENCODINGS, b"".join(element(media.ENCODING, e) for e in encodings))))
    return element(EBML, b"") + element(SEGMENT, track + element(CLUSTER, element(TIME, 0) + element(SIMPLE, laced_block([b"abc", b"de"], 0, "ebml"))))


def test_encoded_tracks(spark):
    strip = encoded(element(media.ENCODING_KIND, 0) + element(media.COMPRESSION, element(media.ALGORITHM, 3) + element(media.STRIPPED, b"<>")))
    p = Parsed(strip)
    assert p.error is None and p.payload(strip) == b"<>abc<>de"
    for data, word in ((encoded(element(media.COMPRESSION, element(media.ALGORITHM, 0))), "compressed"), (encoded(element(media.ENCODING_KIND, 1)), "encrypted"), (encoded(element(media.ENCRYPTION, b"")), "encrypted")):
        p = Parsed(data)
        assert word in p.error and len(p.packets) == 2
    files = spark.createDataFrame([(1, bytearray(strip))], "doc_id long, media binary")
    assert [(r.size, bytes(r.prefix)) for r in media.packet_table(files).orderBy("packet").collect()] == [(3, b"<>"), (2, b"<>")]
