import random
import struct

import pytest

from plumbline.llm import matroska as M


def test_round_trip_of_all_sizes():
    rng = random.Random(1)
    for n in [0, 1, 63, 64, 65, 511, 512, 513, 4095, 4096, 4097, 262143, 262144, 262145, 700001]:
        data = M.padded(rng.randbytes(n))
        assert len(data) % 64 == 0 and len(data) >= 64
        buf = M.mux(data)
        media = M.demux(buf)
        assert b"".join(buf[p.offset : p.offset + p.size] for p in media.packets) == data
        assert media.tracks[1]["codec"] == "A_PCM/INT/LIT" and media.tracks[1]["bits"] == 8 and media.tracks[1]["rate"] == 8000.0
        at = 0
        for p in media.packets:
            assert p.timestamp == at * 1000 // 8000
            at += p.size
        for t, _, spot in media.cues:
            assert buf[spot : spot + 4] == bytes.fromhex("1f43b675") and M.seek(media, t + 1) == spot


def frame_file(block: bytes, group: bool = False, open_end: bool = False, extra: bytes = b"") -> bytes:
    track = M.element(M.TRACKS, M.element(M.TRACK_ENTRY, M.uint(M.TRACK_NUMBER, 1)))
    inner = M.uint(M.TIMESTAMP, 40) + (M.element(M.BLOCK_GROUP, M.element(M.BLOCK, block) + M.uint(M.BLOCK_DURATION, 3)) if group else M.element(M.SIMPLE_BLOCK, block)) + M.element(0xEC, b"\0" * 5)
    size = b"\x01" + b"\xff" * 7 if open_end else M.vint(len(inner))
    body = track + M.ident(M.CLUSTER) + size + inner + M.element(M.CLUSTER, M.uint(M.TIMESTAMP, 90) + M.element(M.SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", -5, 0) + b"zz")) + extra
    return M._HEAD + M.ident(M.SEGMENT) + (b"\xff" if open_end else M.vint(len(body))) + body


@pytest.mark.parametrize("kind", [M.XIPH, M.EBML_LACING, M.FIXED])
@pytest.mark.parametrize("open_end", [False, True])
@pytest.mark.parametrize("group", [False, True])
def test_lacing(kind, open_end, group):
    sizes = [[700, 255, 0, 1000, 254, 3], [6] * 5][kind == M.FIXED]
    data = [bytes([65 + i]) * n for i, n in enumerate(sizes)]
    block = b"\x81" + struct.pack(">hB", 7, 0x80 | kind << 1) + M.laced(sizes, kind) + b"".join(data)
    buf = frame_file(block, group, open_end)
    packets = M.demux(buf).packets
    assert [buf[p.offset : p.offset + p.size] for p in packets] == [*data, b"zz"]
    assert [p.timestamp for p in packets] == [47] * len(sizes) + [85] and packets[0].lacing == kind and packets[-1].lace == 0


def test_numbers():
    for n in [0, 1, 126, 127, 16382, 16383, 2**21, 2**28, 2**40, 2**56 - 2]:
        assert M._number(M.vint(n), 0)[0] == n
    assert M._number(b"\xff", 0)[0] == -1


@pytest.mark.parametrize("bad", [b"", b"RIFF....", M.mux(bytes(640))[:-3], b"\x00" * 9])
def test_bad_files(bad):
    with pytest.raises(M.Bad):
        M.demux(bad)


def test_broken_files_raise_bad_alone():
    rng = random.Random(4)
    block = b"\x81" + struct.pack(">hB", 7, 0x80 | M.XIPH << 1)
    whole = [frame_file(block + M.laced([700, 255, 3], M.XIPH) + bytes(958)), frame_file(block + b"\x03\xff\xff"), frame_file(block), M.mux(rng.randbytes(6400)), frame_file(b"\x81" + struct.pack(">hB", 7, 0x80 | M.EBML_LACING << 1) + b"\x02\x40")]
    for buf in whole:
        for _ in range(400):
            x = bytearray(buf)
            for _ in range(rng.randint(0, 3)):
                x[rng.randrange(len(x))] = rng.randrange(256)
            try:
                M.demux(bytes(x[: rng.choice([len(x), rng.randrange(len(x))])]))
            except M.Bad:
                pass


def test_broken_files_in_a_table(spark):
    rows = [(1, bytearray(M.mux(bytes(64)))), (2, bytearray(b"RIFF")), (3, None), (4, bytearray(M.mux(bytes(640))[:-3])), (None, bytearray(b""))]
    out = M.packet_table(spark.createDataFrame(rows, "doc_id long, media binary")).collect()
    assert sorted((r.doc_id or 0, r.track is None, r.error is None) for r in out) == [(0, True, False), (1, False, True), (2, True, False), (4, True, False)]


def test_query_on_texts(spark):
    rows = [(1, "abc", "x"), (2, None, "x"), (3, "", "y"), (4, "é" * 5000, "z"), (5, "abc", "w"), (5, "abc", "w"), (6, "a" * 64, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, media string")
    out = [r.asDict() for r in M.read_back(M.encode_texts(df)).collect()]
    import hashlib
    import zlib

    for r, (i, t, _) in zip(sorted(out, key=lambda r: r["doc_id"]), sorted(rows, key=lambda r: r[0])):
        raw = (t or "").encode()
        pay = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        buf = M.mux(pay)
        assert (r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (i, len(raw), len(pay), hashlib.sha256(pay).hexdigest())
        assert (r["tail_crc32"], r["media_bytes"], r["media_sha256"]) == (zlib.crc32(pay[-64:]), len(buf), hashlib.sha256(buf).hexdigest())
    assert len({r["feature"] for r in out if r["doc_id"] in (1, 5)}) == 1
    packets = M.packet_table(M.encode_texts(df)).where("doc_id = 4").orderBy("offset").collect()
    assert sum(p["size"] for p in packets) == -(-10000 // 64) * 64
    assert M.read_back(M.encode_texts(df.limit(0))).count() == 0
