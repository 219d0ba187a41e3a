"""Operators 3, 8 and 9 by brute force and exact round trips."""

import hashlib
import zlib

import pytest

from gneiss.llm import ogg, queries, sharding, warc
from tests.llm import cases


def test_sharding_query(spark, tmp_path):
    folder = cases.write(cases.documents(spark), tmp_path, "documents")
    got = queries.op3_prefix_sum_sharding(spark, folder).collect()
    rows = sorted(((i is not None, i or 0, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in cases.texts()))
    total, at, want, slots = sum(r[2] for r in rows), 0, [], {}
    for has, i, size, crc in rows:
        s = min(23, (2 * at + size) * 24 // (2 * total))
        want.append((i if has else None, size, crc, s, slots.get(s, 0)))
        slots[s] = slots.get(s, 0) + 1
        at += size
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(((r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in got), key=key) == sorted(want, key=key)
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}


def test_sharding_of_nothing(spark):
    assert sharding.shard(cases.nothing(spark)).count() == 0


def test_ogg_checksum_by_definition():
    def slow(data):
        crc = 0
        for b in data:
            crc ^= b << 24
            for _ in range(8):
                crc = ((crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
        return crc

    for data in (b"", b"\0", b"OggS", bytes(range(256))):
        assert ogg.checksum(data) == slow(data)


def page_ends(sizes):
    """Which packets are the last to end on their page, by laying the segments out one by one."""
    page, used, last = 0, 0, {}
    for k, n in enumerate(sizes):
        for _ in range(n // 255 + 1):
            if used == 255:
                page, used = page + 1, 0
            used += 1
        last[page] = k
        if k == 0:
            page, used = page + 1, 0
    return set(last.values())


@pytest.mark.parametrize("sizes", [[0], [1, 254, 255, 256], [510, 0, 65025, 65024, 65026], [200_000, 3], [255 * 255 * 2], [30] + [4096] * 40 + [77]])
def test_ogg_packets_and_granules_survive(sizes):
    packets = [(bytes((i + k) % 251 for i in range(n)), sum(sizes[1 : k + 1])) for k, n in enumerate(sizes)]
    other = [(b"head", 0), (b"x" * 300, 15), (b"", 25)]
    data = ogg.build({7: packets, 9: other})
    (one, two), bad = ogg.parse(data)
    assert bad == 0 and one.packets == [p for p, _ in packets] and two.packets == [p for p, _ in other]
    ends = page_ends(sizes)
    assert one.granules == [g if k in ends else -1 for k, (_, g) in enumerate(packets)]
    assert one.spans(len) == [(g - len(p), g) for p, g in packets[1:]]
    assert one.ended and two.ended and not one.lost


def test_ogg_times_of_many_packets_on_a_page():
    payload = bytes(range(256)) * 320  # 20 frames of 4096, fifteen of them on the first page
    back, info = ogg.load(ogg.store(payload))
    assert back == payload and info["packets"] == 20
    assert info["spans"] == ",".join(f"{k * 512_000}-{(k + 1) * 512_000}" for k in range(20))


def test_ogg_last_packet_is_cut_by_the_end():
    (s,), _ = ogg.parse(ogg.build({1: [(b"h", 0), (b"a", 100), (b"b", 200), (b"c", 250)]}))
    assert s.spans(lambda _: 100) == [(0, 100), (100, 200), (200, 250)]
    (s,), _ = ogg.parse(ogg.build({1: [(b"h", 0), (b"a", 1100), (b"b", 1200)]}))  # begins late: told from behind
    assert s.spans(lambda _: 100) == [(1000, 1100), (1100, 1200)]


def test_ogg_chained_serials_are_streams_of_their_own():
    first, second = [(b"h", 0), (b"abc", 3)], [(b"H", 0), (b"defg", 4)]
    streams, bad = ogg.parse(ogg.build({5: first}) + ogg.build({5: second}))
    assert bad == 0 and [s.packets for s in streams] == [[b"h", b"abc"], [b"H", b"defg"]]
    assert all(s.ended and not s.lost for s in streams)


def test_ogg_damage_is_found():
    data = bytearray(ogg.store(b"a" * 10_000))
    at = len(data) // 2
    data[at] ^= 1
    _, bad = ogg.parse(bytes(data))
    assert bad
    with pytest.raises(ValueError):
        ogg.load(bytes(data))
    junk = b"OggS junk" + ogg.store(b"b" * 64)
    streams, bad = ogg.parse(junk)
    assert bad == 1 and len(streams) == 2


def test_ogg_query(spark, tmp_path):
    folder = cases.write(cases.documents(spark), tmp_path, "documents")
    got = queries.op8_ogg_media(spark, folder).collect()
    want = []
    for i, t in cases.texts():
        raw = (t or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        media = ogg.store(payload)
        level = [b - 128 for b in payload]
        mean, rms = sum(level) / len(level), (sum(v * v for v in level) / len(level)) ** 0.5
        spans = [(a * 125, min(a + 4096, len(payload)) * 125) for a in range(0, len(payload), 4096)]
        said = f"packets={len(spans)};rate=8000;micros={spans[-1][1]};spans={','.join(f'{a}-{b}' for a, b in spans)};mean={mean:.6f};rms={rms:.6f}"
        want.append((i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), said))
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(((*tuple(r)[:7], r.feature[r.feature.index("packets=") :]) for r in got), key=key) == sorted(want, key=key)
    assert queries.op8_ogg_media(spark, cases.write(cases.nothing(spark), tmp_path / "e", "documents")).count() == 0


PAGES = [(i, f"http://h/{i}", "<p>" + "unique %d " % i * 80 + "</p>") for i in range(30)]
PAGES += [(100 + i, None, "<p>" + "same body " * 200 + "</p>") for i in range(5)] + [(200, "u", None), (201, "u\r\nx", ""), (202, "u", "short"), (203, "u", "short"), (204, "u", "é" * 600), (205, "u", "é" * 600)]


def test_warc_query(spark, tmp_path):
    df = spark.createDataFrame([(*p, "clash", 1) for p in PAGES], "page_id long, url string, html string, digest string, records int")
    got = {r.page_id: tuple(r)[1:] for r in queries.op9_dictionary_warc(spark, cases.write(df, tmp_path, "pages")).collect()}
    latest = {}
    for i, _, html in PAGES:
        latest[html or ""] = max(i, latest.get(html or "", i))
    for i, _, html in PAGES:
        raw = (html or "").encode()
        revisit = len(raw) >= 1000 and latest[html or ""] != i
        assert got[i] == (len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", latest[html or ""] if revisit else None)
    assert len(got) == len(PAGES)
    empty = spark.createDataFrame([], df.schema)
    assert queries.op9_dictionary_warc(spark, cases.write(empty, tmp_path / "e", "pages")).count() == 0


def test_warc_odd_pages_and_every_way_to_the_keeper(spark):
    body, other = "x" * 2000, "y" * 1500
    data = [(None, "u", body), (1, "u", body), (1, "u", body), (9, None, body), (9, "v", body), (None, "u", other), (None, "u", other), (4, "u", "z" * 9_000_000), (5, "u", "z" * 9_000_000)]
    df = spark.createDataFrame(data, "page_id long, url string, html string")
    got = warc.read(warc.archives(df)).select("page_id", "record_type", "refers_to", "payload_bytes").collect()
    want = [(None, "revisit", 9, 2000), (1, "revisit", 9, 2000), (1, "revisit", 9, 2000), (9, "response", None, 2000), (9, "response", None, 2000)]
    want += [(None, "response", None, 1500)] * 2 + [(4, "revisit", 5, 9_000_000), (5, "response", None, 9_000_000)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    digest = lambda t: hashlib.sha1(t.encode()).digest()
    rows = spark.createDataFrame([(i, bytearray(t.encode()), bytearray(digest(t))) for i, _, t in data], "page_id long, payload binary, digest binary")
    kept = spark.createDataFrame([(bytearray(digest(body)), 9, 50_000), (bytearray(digest("z" * 9_000_000)), 5, 2)], "kept_digest binary, kept long, n long")
    ways = [sorted(str((r.page_id, r.kept)) for r in warc.with_keepers(rows, kept, 120, 50_002, 1000, bound).collect()) for bound in (0, 1_000_000)]
    assert ways[0] == ways[1] == sorted(str((i, 9 if t == body else 5 if t[0] == "z" else None)) for i, _, t in data)


def test_warc_archive_form(tmp_path, spark):
    import struct

    records = [warc.encode_record([("WARC-Type", "response"), ("N", str(i))], b"body %d " % i * 50) for i in range(200)]
    data = warc.compress(records)
    magic, size = struct.unpack_from("<II", data)
    assert magic == 0x184D2A5D and size > 0 and [*warc.decompress(data)] == records
    assert len(data) < sum(map(len, records)) / 4
    with pytest.raises(ValueError):
        [*warc.decompress(data[:-3])]
    with pytest.raises(ValueError):
        warc.decode_record(records[0][:-6])
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    (tmp_path / "out").mkdir()
    warc.export(warc.archives(df), str(tmp_path / "out"))
    files = [*(tmp_path / "out").glob("*.warc.zst")]
    assert files and sum(len([*warc.decompress(f.read_bytes())]) for f in files) == len(PAGES)
