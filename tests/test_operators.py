"""Operators that SQL doesn't express, and odd inputs."""

import random
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mosaiq.functions import codecs as K
from mosaiq.functions import color as C
from mosaiq.operators import aggregate as A
from mosaiq.operators import dedup as D
from mosaiq.operators import lookup as L
from mosaiq.operators import quantize as Q
from mosaiq.operators import sequence as S
from mosaiq.sources import files as W
from mosaiq.sources import objects as O
from mosaiq.streaming.playback import Player, play_stream


# ---- codecs

@pytest.mark.parametrize("kind", [k for k in K.PACK if k != "none"])
@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"ab", b"abc" * 7, b"\0", b"\xff" * 200, b"xyz", b"a" * 9]), max_size=40).map(b"".join))
def test_round_trip(kind, data):
    packed = K.PACK[kind](data)
    if kind == "segments" and not data:
        return  # no segments, which isn't well-formed
    assert K.UNPACK[kind](packed) == data
    assert K.UNPACK[K.detect(packed)] is not None


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=60))
def test_decoders_reject_or_decode(data):
    for kind, fn in K.UNPACK.items():
        try:
            fn(data)
        except ValueError:
            continue
        assert kind


def test_known_values():
    assert K.crc16(b"123456789") == 0x4B37
    assert K.pack_runs(b"aaaa") == K.header(K.RUNS, 4) + b"\x81a"
    assert K.unpack_lz(K.header(K.LZ, 6) + b"\x20ab\x10\x01") == b"ababab"
    assert K.undiff8(K.diff8(b"\x05\x03\xff")) == b"\x05\x03\xff"
    assert K.canonical({1: 2, 2: 1, 3: 2}) == {2: (0, 1), 1: (2, 2), 3: (3, 2)}
    assert sum(2.0**-n for n in K.code_lengths({i: i * i + 1 for i in range(40)}).values()) == 1.0
    assert K.smallest(b"")[0] in K.PACK


def shortest_runs(data):
    """Bytes of the shortest run-length form, over every division."""
    n = len(data)
    cost = [0] + [10**9] * n
    for i in range(n):
        for j in range(i + 1, min(n, i + 130) + 1):
            if j - i <= 128:
                cost[j] = min(cost[j], cost[i] + 1 + j - i)
            if j - i >= 3 and len(set(data[i:j])) == 1:
                cost[j] = min(cost[j], cost[i] + 2)
    return cost[n]


def test_runs_are_nearly_shortest():
    r = random.Random(1)
    for _ in range(200):
        data = b"".join(bytes([r.choice(b"abc")]) * r.randrange(1, 6) for _ in range(r.randrange(20)))
        assert len(K.pack_runs(data)) - 4 <= shortest_runs(data) + 1


# ---- colours

def test_color_depths_equal_rounding(spark):
    t = spark.range(256).select("id", C.to5(F.col("id")).alias("a"), C.round15(F.col("id")).alias("b"), C.round18(F.col("id")).alias("c")).collect()
    for x in t:
        assert x.a == round(x.id * 31 / 255) and abs(x.b - x.id) <= 4 and abs(x.c - x.id) <= 2


def test_create_palette(spark):
    r = random.Random(2)
    colors = [(250, 10, 10), (10, 240, 20), (20, 20, 230), (240, 240, 240)]
    px = spark.createDataFrame([(0, i % 32, i // 32, *(min(255, max(0, v + r.randrange(-3, 4))) for v in r.choice(colors)), 255) for i in range(1024)], "img long, x long, y long, r long, g long, b long, a long")
    hist = Q.histogram(px)
    found = Q.create_palette(hist, 4)
    assert len(found) == 4 and all(min(sum(abs(a - b) for a, b in zip(c, p[1:], strict=True)) for p in found) < 20 for c in colors)
    few, many = (Q.palette_error(hist, Q.create_palette(hist, n)).first()[0] for n in (2, 8))
    assert many < few
    assert Q.create_palette(hist.limit(0), 4) == []
    one = Q.diffused(px, found).toPandas()
    assert len(one) == 1024 and set(one["idx"]) <= {p[0] for p in found}
    assert np.isclose(np.linalg.norm(Q.principal_axis(hist)), 1.0)


# ---- tiles

def test_merge_flipped_turns_back(spark):
    r = random.Random(3)
    base = [[r.randrange(4) for _ in range(64)] for _ in range(5)]
    tiles = [(k, [base[k % 5][i ^ m] for i in range(64)]) for k in range(30) for m in [D.FLIPS[r.randrange(4)]]]
    px = spark.createDataFrame([(k, i, v) for k, p in tiles for i, v in enumerate(p)], "tile_no long, pos long, idx long")
    got = D.merge_flipped(D.tile_arrays(px)).collect()
    own = dict(tiles)
    assert all([own[x.master][i ^ D.FLIPS[x.flip]] for i in range(64)] == own[x.tile_no] for x in got)
    assert len({x.id for x in got}) == len({x.master for x in got}) == 5
    assert D.merge_flipped(D.tile_arrays(px.limit(0))).count() == 0


def test_merge_to_keeps_the_bound():
    r = random.Random(4)
    tiles = [(k, [r.randrange(3) for _ in range(64)]) for k in range(12)]
    of = D.merge_to(tiles, 5)
    assert len(set(of.values())) == 5 and all(of[m] == m for m in of.values())
    assert D.merge_to([], 3) == {}


def test_string_pool_shares(spark):
    rows = spark.createDataFrame([(1, 0, "abc"), (1, 1, "bc"), (1, 2, "abc"), (1, 3, None), (2, 0, "x")], "file_id long, pos long, text string")
    got = {(x.file_id, x.pos): x.offset for x in D.pool_strings(rows).collect()}
    assert got[1, 0] == got[1, 2] == 0 and got[1, 1] == 1 and got[1, 3] == 3 and got[2, 0] == 0


# ---- playback

def test_timeline_equals_player(spark):
    r = random.Random(5)
    banks = {s: ([r.randrange(1, 4) for _ in range(r.randrange(1, 6))], 1 + s % 4) for s in range(24)}
    frames = spark.createDataFrame([(s, i, x, mode) for s, (d, mode) in banks.items() for i, x in enumerate(d)], "seq long, frame_no long, duration long, mode long")
    ticks = spark.createDataFrame([(s, t) for s in banks for t in range(40)], "seq long, tick long")
    got = {(x.seq, x.tick): x.frame_no for x in S.at_ticks(frames, ticks).collect()}
    for s, (d, mode) in banks.items():
        p = Player(d, mode)
        p.play()
        for t in range(40):
            assert got[s, t] == p.frame, (s, t, d, mode)
            p.tick()


def test_player_commands():
    p = Player([1, 1, 1], 4)
    p.tick()
    assert p.frame == 0
    p.play()
    seen = []
    for _ in range(7):
        p.tick()
        seen.append(p.frame)
    assert seen == [1, 2, 1, 0, 1, 2, 1]
    p.pause()
    p.tick()
    assert p.frame == 1
    p.stop()
    p.play()
    assert p.frame == 0 and p.direction == 1


def test_play_stream(spark, tmp_path):
    frames = spark.createDataFrame([(s, i, 2, 2) for s in (1, 2) for i in range(3)], "seq long, frame_no long, duration long, mode long")
    schema = "seq long, tick long, command string"
    spark.createDataFrame([(s, t, "play" if t == 0 else "tick") for s in (1, 2) for t in range(5)], schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    q = play_stream(stream, frames).writeStream.format("memory").queryName("played").outputMode("append").start()
    try:
        q.processAllAvailable()
        spark.createDataFrame([(s, t, "tick") for s in (1, 2) for t in range(5, 9)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        until = time.time() + 60
        while spark.table("played").count() < 18 and time.time() < until:
            q.processAllAvailable()
        got = {(x.seq, x.tick): x.frame_no for x in spark.table("played").collect()}
    finally:
        q.stop()
    assert [got[1, t] for t in range(9)] == [0, 0, 1, 1, 2, 2, 0, 0, 1] == [got[2, t] for t in range(9)]


# ---- joins, gaps, files

def test_overlaps_and_empty(spark):
    r = random.Random(6)
    rects = [(0, i, r.randrange(-100, 100), r.randrange(-100, 100), r.randrange(1, 90), r.randrange(1, 90)) for i in range(60)]
    df = spark.createDataFrame(rects, "g long, id long, x long, y long, w long, h long")
    want = {(a[1], b[1]) for a in rects for b in rects if a[1] < b[1] and a[2] < b[2] + b[4] and b[2] < a[2] + a[4] and a[3] < b[3] + b[5] and b[3] < a[3] + a[5]}
    got = [(x.a, x.b) for x in L.overlapping(df, "g").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert L.overlapping(df.limit(0), "g").count() == 0


def test_within_checks_the_size(spark):
    small, large = spark.range(5), spark.range(20)
    assert "broadcast" in L.within(small, 10)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in L.within(large, 10)._jdf.queryExecution().logical().toString().lower()


def test_used_bytes(spark):
    df = spark.createDataFrame([(1, 0, 4), (1, 2, 6), (1, 6, 7), (1, 9, 9), (1, 10, 12)], "g long, start long, stop long")
    assert sorted((x.start, x.stop) for x in A.used_bytes(df).collect()) == [(0, 7), (9, 9), (10, 12)]


def test_flood_and_cover(spark):
    px = spark.createDataFrame([(0, x, y, int(x < 4), 255 if x < 20 and y < 9 else 0) for x in range(24) for y in range(16)], "img long, x long, y long, idx long, a long")
    assert S.flood(px, 5, 5).count() == 20 * 16
    rects = S.covering(px).collect()
    assert all(any(r.x <= x < r.x + r.w and r.y <= y < r.y + r.h for r in rects) for x in range(20) for y in range(9))


def test_chunks_and_messages(spark):
    good = O.pack_messages([(5, b"one"), (6, b""), (9, "zwei é".encode())])
    assert O.message_list(good) == [(5, b"one"), (6, b""), (9, "zwei é".encode())]
    df = spark.createDataFrame([("a", good), ("b", b"junk"), ("c", None), ("d", good[:20])], "path string, bytes binary")
    assert [(x.path, x.signature) for x in O.chunks(df).orderBy("path", "k").collect()] == [("a", "INF1"), ("a", "DAT1"), ("a", "MID1")]
    assert [x.text for x in O.read_messages(df).orderBy("pos").collect()] == ["one", "", "zwei é"]


def test_binary_files(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(K.pack_lz(b"tile" * 40))
    (tmp_path / "b.bin").write_bytes(bytes(range(64)))
    got = {x.path.rsplit("/", 1)[1]: (x.codec, len(x.bytes)) for x in O.unpacked(O.read_files(spark, str(tmp_path))).collect()}
    assert got == {"a.bin": ("lz", 160), "b.bin": ("none", 64)}


def _rows_of(kind, r):
    plain = W.PLAIN
    return {
        "palette": [(i, r.randrange(1, 32768)) for i in range(64)],
        "character": [(t, p, r.randrange(16)) for t in range(5) for p in range(64)],
        "screen": [(32, 24, c, r.randrange(4096)) for c in range(768)],
        "cell": [(k, k % 3, i, *(r.randrange(65536) for _ in range(3))) for k in range(4) for i in range(k + 1)],
        "animation": [(s, 0, 1, 1 + s % 4, i, 1 + r.randrange(9), r.randrange(50), *((r.randrange(65536), 4096 + i, 4096, -9, 3) if s % 3 == 1 else (*plain[:3], i, 2) if s % 3 == 2 else plain)) for s in range(5) for i in range(3)],
        "texture": [(0, 0, 5), (0, 1, 8), (0, 2, 16), (0, 3, 0), (0, 4, 0), *((1, k, r.randrange(256)) for k in range(32)), *((2, k, r.randrange(65536)) for k in range(8)), *((3, k, r.randrange(32768)) for k in range(12))],
        "layout": [(n, r.randrange(-2048, 2048), r.randrange(-2048, 2048), n % 3, 1, 0, 2, r.randrange(256), 0) for n in range(9)],
        "multicell": [(m, n, r.randrange(9), r.randrange(-50, 50), r.randrange(-50, 50), r.randrange(4)) for m in range(3) for n in range(m + 1)],
    }[kind]


@pytest.mark.parametrize("f", [f for f in W.FORMATS.formats if f.write], ids=lambda f: f"{f.kind}-{f.name}")
def test_formats_round_trip_and_reject(f):
    r = random.Random(31)
    rows = _rows_of(f.kind, r)
    data = f.write(rows)
    assert sorted(f.read(data)) == sorted(rows) and f.valid(data)
    if f.checks not in ((), ("size",)):
        assert W.FORMATS.identify(data)[0] is f
        assert not any(f.valid(data[:n]) for n in (0, 3, 11, len(data) // 2))
    for _ in range(200):  # damaged files are refused or read, never worse
        bad = bytearray(data)
        for _ in range(3):
            bad[r.randrange(len(bad))] = r.randrange(256)
        assert f.valid(bytes(bad)) in (True, False)


def test_formats_of_known_bytes():
    """Files written out by hand: a palette of four colours, new, old and compressed; a bitmap of two tiles; a big-endian message file."""
    head = lambda sig, size, n=1: sig + b"\xff\xfe\x00\x01" + size.to_bytes(4, "little") + b"\x10\x00" + n.to_bytes(2, "little")
    body = (3).to_bytes(4, "little") + bytes(4) + (8).to_bytes(4, "little") + (16).to_bytes(4, "little") + b"\x01\x00\x02\x00\x03\x00\x04\x00"
    new = head(b"RLCN", 48) + b"TTLP" + (32).to_bytes(4, "little") + body
    old = head(b"RLCN", 40) + b"TTLP" + (24).to_bytes(4, "little") + body
    want = [(0, 1), (1, 2), (2, 3), (3, 4)]
    assert W.FORMATS.named("palette", "NCLR").read(new) == want == W.FORMATS.named("palette", "NCLR").read(old)
    assert W.FORMATS.named("palette", "NCLR").write(want) == new
    sparse = [(i, i if i // 16 == 2 else 0) for i in range(256)]
    packed = W.write_compressed_nclr(sparse)
    assert W.FORMATS.named("palette", "NCLR").read(packed) == sparse and len(packed) < 100
    px = bytes(range(64))  # two tiles side by side, 16 pixels a row, 4 bits each
    char = (1).to_bytes(2, "little") + (2).to_bytes(2, "little") + b"".join(n.to_bytes(4, "little") for n in (3, 0, 1, 64, 24)) + px
    got = W.FORMATS.named("character", "NCGR").read(head(b"RGCN", 16 + 8 + len(char)) + b"RAHC" + (8 + len(char)).to_bytes(4, "little") + char)
    assert [v for t, p, v in got if t == 1][:8] == [4, 0, 5, 0, 6, 0, 7, 0] and [v for t, p, v in got if t == 0][8:10] == [8, 0]
    inf = (1).to_bytes(2, "big") + (4).to_bytes(2, "big") + bytes(4) + (1).to_bytes(4, "big")
    blocks = b"".join(n + (32).to_bytes(4, "big") + d.ljust(24, b"\0") for n, d in ((b"INF1", inf), (b"DAT1", b"\0hi\0")))
    assert O.message_list(b"MESGbmg1" + (96).to_bytes(4, "big") + (2).to_bytes(4, "big") + b"\x04" + bytes(15) + blocks) == [(0, b"hi")]
    assert O.pack_messages([(0, b"hi")])[:20] == b"MESGbmg1" + (128).to_bytes(4, "little") + (3).to_bytes(4, "little") + b"\x04\0\0\0"


def test_segments_and_offset_blocks():
    pair = lambda *p: b"".join(x.to_bytes(4, "little") for x in p)
    f = W.FORMATS.named("animation", "Segments")
    assert [x[4:7] for x in f.read(pair(8, 4, 0, 8, 8, 4))] == [(0, 1, 0), (1, 1, 1), (2, 1, 2)]
    assert not any(map(f.valid, (pair(4, 4), pair(0, 8, 4, 8), pair(0, 8, 0, 4), pair(0, 6), b"", pair(0, 8, 12, 4))))
    blocks = [("TEX0", b"abcd"), ("PAL0", b"xyz")]
    data = W.pack_offset_blocks("BTX0", blocks)
    assert W.offset_block_list(data) == [("TEX0", b"abcd"), ("PAL0", b"xyz\0")]
    for bad in (data[:-1], data[:20], b"", data[:16] + b"\xff" * 8 + data[24:]):
        with pytest.raises(ValueError):
            W.offset_block_list(bad)


def test_files_are_saved_and_read_again(spark, tmp_path):
    df = spark.createDataFrame([("a/x.pal", bytes(range(64))), ("b.bin", b""), ("c", None)], "path string, bytes binary")
    for _ in range(2):  # a second time leaves the same
        assert sorted(tuple(x) for x in W.save(df, f"file://{tmp_path}/out").collect()) == [("a/x.pal", 64), ("b.bin", 0)]
    assert (tmp_path / "out/a/x.pal").read_bytes() == bytes(range(64)) and not list(tmp_path.rglob("*.part"))
    got = {x.path: (x.codec, x.kind, x.format) for x in W.identify(df).collect()}
    assert got == {"a/x.pal": ("none", "palette", "Binary"), "b.bin": ("none", "palette", "NTFP"), "c": ("none", "invalid", "")} or got["a/x.pal"][1:] == ("palette", "Binary")


def test_stream_builder():
    s = W.Stream()
    assert s.write(b"abc") == 0 and s.seek(1) == 1 and s.write(b"XY") == 1 and s.seek(2, 2) == 5 and s.write(b"z") == 5
    assert bytes(s.data) == b"aXY\0\0z"
    s.seek(0)
    s.insert(b"__")
    s.align(8)
    assert bytes(s.data) == b"__aXY\0\0z" and s.seek(-100, 1) == 0 and s.take(3) == b"__a" and s.at == 3


def test_name_trees_and_directories():
    from mosaiq.functions.text import name_hash

    r = random.Random(35)
    names = [bytes(r.choice(b"abcd_") for _ in range(r.randrange(1, 20))) for _ in range(60)]
    names = list({n[:16]: n for n in names}.values())
    tree = W.name_tree(names)
    assert [W.find_name(tree, names, n) for n in names] == list(range(len(names))) and W.find_name(tree, names, b"none such") == -1
    assert W.find_name(W.name_tree([]), [], b"x") == -1 and W.name_tree([b"x"]) == 0
    with pytest.raises(ValueError):
        W.name_tree([b"same", b"same"])
    own = [(n.decode(), n * 3) for n in names]
    data = W.pack_directory(own)
    found = W.directory(data)
    assert [h for _, h, _ in found] == sorted(name_hash(n) for n in names)
    assert all(data[at : at + 3 * len(n)] == n.encode() * 3 for n, _, at in found)


def test_pinned_and_reserved_colors(spark):
    r = random.Random(36)
    px = spark.createDataFrame([(0, i % 32, i // 32, *r.choice([(250, 10, 10), (10, 240, 20), (20, 20, 230)]), 255) for i in range(600)], "img long, x long, y long, r long, g long, b long, a long")
    got = Q.create_palette(Q.histogram(px), 4, pinned=[(1, 2, 3)], reserve=1)
    assert got[0] == (1, 1, 2, 3) and [p[0] for p in got] == [1, 2, 3, 4] and len({p[1:] for p in got}) == 4
    assert all(min(sum(abs(a - b) for a, b in zip(c, p[1:], strict=True)) for p in got) < 12 for c in [(250, 10, 10), (10, 240, 20), (20, 20, 230)])


def test_ticks_come_at_a_rate(spark):
    from mosaiq.streaming.playback import tick_source

    bank = spark.createDataFrame([(1,), (2,)], "seq long")
    q = tick_source(spark, bank, 20).writeStream.format("memory").queryName("ticked").start()
    try:
        until = time.time() + 60
        while spark.table("ticked").count() < 10 and time.time() < until:
            time.sleep(0.5)
        got = [(x.seq, x.tick, x.command) for x in spark.table("ticked").collect()]
    finally:
        q.stop()
    assert {(1, 0, "play"), (2, 0, "play"), (1, 1, "tick")} <= set(got)


def test_messages_in_either_order_and_wide():
    for order in "<>":
        assert O.message_list(O.pack_messages([(9, b"ab"), (2, b"b")], order=order, extra=b"xy")) == [(9, b"ab"), (2, b"b")]
    wide = "né".encode("utf-16-le")
    assert O.message_list(O.pack_messages([(0, wide), (1, b"")], encoding=2)) == [(0, wide), (1, b"")]


def test_registry_takes_new_formats_once():
    own = W.Registry([W.FORMATS.named("palette", "NCLR")])
    f = own.register(W.Format("palette", "Mine", ("header", "signature"), lambda data: [(0, 7)] if data[:4] == b"MINE" else 1 / 0 if not data else (_ for _ in ()).throw(ValueError("no"))))
    assert own.identify(b"MINE") == [f] and f.confidence == 500 and own.identify(b"other") == []
    with pytest.raises(ValueError):
        own.register(f)
    with pytest.raises(ValueError):
        own.register(W.Format("no such kind", "x", (), f.read))


def test_identification_goes_by_codec_ending_check_guess_and_size():
    r = random.Random(32)
    pal = W.FORMATS.named("palette", "NCLR").write(_rows_of("palette", r))
    assert W.identified(pal) == ("none", "palette", "NCLR") and W.identified(K.pack_lz(pal)) == ("lz", "palette", "NCLR")
    raw = bytes(range(64))
    assert W.identified(raw, "a.ntfp")[1:] == ("palette", "NTFP") and W.identified(raw, "a.NBFC")[1:] == ("character", "Binary")
    assert W.identified(raw, kind="character")[1:] == ("character", "Binary") and W.identified(b"abc")[1:] == ("invalid", "")


def test_huffman_of_known_bytes():
    # Symbols 7 and 9 under one node: 7 is the left leaf, 9 the right one; bits 0 1 1 0, padded to a word of 32, stored from its lowest byte.
    assert K.unpack_huffman(K.header(K.HUFFMAN8, 4) + bytes((1, 0xC0, 7, 9)) + (0b0110 << 28).to_bytes(4, "little")) == bytes((7, 9, 9, 7))
    # Half bytes 1 (bit 0) and 2 (bit 1), the low half first.
    assert K.unpack_huffman(K.header(K.HUFFMAN4, 1) + bytes((1, 0xC0, 1, 2)) + (0b01 << 30).to_bytes(4, "little")) == b"\x21"
    with pytest.raises(ValueError):
        K.unpack_huffman(K.header(K.HUFFMAN8, 4) + bytes((1, 0x00, 7, 9)) + bytes(4))


def test_formulas_of_known_values(spark):
    """Worked out by hand from the formats' rules."""
    from mosaiq.functions import packed as P
    from mosaiq.functions import text as T

    assert T.name_hash(b"") == 0
    h = 0x61 >> 5 | 0x61 << 11 & 0xFFFF  # one letter: turned right by 5, its upper byte added, the length in
    assert T.name_hash(b"a") == ((h + (h >> 8)) & 0xFFFF) ^ 1 == 0x080A
    one = spark.range(1)
    value = lambda column: one.select(column.alias("v")).first().v
    lit = lambda v: F.lit(v).cast("bigint")
    assert value(P.hash3(lit(0x12), lit(0x34), lit(0xF6))) == 0x12 ^ 0x26 << 1 ^ 0xE4 << 2 & 0x1FF ^ 0xE4 >> 7
    assert [value(P.permille_changed(lit(a), lit(b))) for a, b in ((1000, 250), (1000, 1500), (0, 5), (3, 1))] == [750, 500, 0, 667]
    assert value(C.gray(lit(31), lit(31), lit(31))) == 31 and value(C.gray(lit(31), lit(0), lit(0))) == int(31 * 0.2126 ** (1 / 2.2) + 0.5) == 15
    got = [value(x) for x in C.over((lit(200), lit(0), lit(0), lit(128)), (lit(0), lit(100), lit(0), lit(64)))]
    assert got == [200 * 32640 // 40768, 100 * 8128 // 40768, 0, 40768 // 255]
    assert [value(x) for x in C.over((lit(1), lit(2), lit(3), lit(0)), (lit(4), lit(5), lit(6), lit(7)))] == [4, 5, 6, 7]


def test_guess_kind():
    assert O.guess_kind(np.arange(256, dtype="<u2").tobytes()) in ("palette", "screen", "character")
    assert O.guess_kind(b"") == "palette" and O.guess_kind(b"abc") == "invalid"
    assert O.guess_kind((np.arange(1024, dtype="<u2") % 768 | 0x8000).tobytes()) == "screen"
    assert O.guess_kind(b"\x22" * 96 + bytes(range(128, 160))) == "character"


def test_principal_order_follows_the_axis(spark):
    r = random.Random(33)
    rows = [(i * 4, 2 * i + r.randrange(3), r.randrange(20), 1 + i % 3) for i in range(60)]
    got = Q.principal_order(spark.createDataFrame(rows, "r long, g long, b long, w long")).orderBy("place").collect()
    x = np.array([(p.r, p.g, p.b) for p in got]) @ np.array(C.YIQ).T
    axis = np.linalg.eigh(np.cov(x.T, aweights=[p.w for p in got], ddof=0))[1][:, -1]
    scores = x @ (axis if axis[0] >= 0 else -axis)
    assert (np.diff(scores) > -1e-6).all() and [p.place for p in got] == list(range(60))


def test_frames_between_two(spark):
    one = spark.createDataFrame([(1, 10, 0, 9, -5, 7, 0, 3, 4096, 8192, 4096, 0, 65000, 500)], "id long, total long, index0 long, index1 long, px0 long, px1 long, py0 long, py1 long, sx0 long, sx1 long, sy0 long, sy1 long, rot_z0 long, rot_z1 long")
    for clockwise in (True, False):
        a, b = 65000, 500
        a, b = (a, b + 65536) if clockwise else (a, b)
        want = [((a * 2 * (3 - i) + b * 2 * (i + 1) + 4) // 8) % 65536 for i in range(3)]
        got = S.interpolated_frames(one, 3, clockwise).orderBy("i").collect()
        assert [x.rot_z for x in got] == want and sum(x.duration for x in got) == 10 and [x["index"] for x in got] == [(9 * 2 * (i + 1) + 4) // 8 for i in range(3)]
    wide = S.widened(spark.createDataFrame([(1, 5, None)], "index long, px long, rot_z long")).first()
    assert (wide.rot_z, wide.sx, wide.sy, wide.px, wide.py) == (0, 4096, 4096, 5, 0)


def test_alpha_distance_is_the_mean_over_backgrounds(spark):
    r = np.random.default_rng(34)
    back = r.uniform(0, 255, (200_000, 3)) @ np.array(C.YIQ).T
    one = spark.range(1)
    p, q = (np.array([100.0, -20.0, 30.0]) * 0.4, 0.4), (np.array([180.0, 40.0, -10.0]) * 0.9, 0.9)
    seen = ((p[0] + (1 - p[1]) * back) - (q[0] + (1 - q[1]) * back)) * 20
    got = one.select(C.alpha_distance((*map(F.lit, p[0].tolist()), F.lit(p[1])), (*map(F.lit, q[0].tolist()), F.lit(q[1]))).alias("d")).first().d
    assert abs(got / (seen**2).sum(axis=1).mean() - 1) < 0.02


def test_neighbour_chain():
    assert S.neighbour_chain([(0, 0, 0), (9, 0, 0), (1, 0, 0), (4, 0, 0)]) in ([0, 2, 3, 1], [1, 3, 2, 0])
    assert S.neighbour_chain([]) == []


# ---- text, backgrounds

@settings(max_examples=120, deadline=None)
@given(st.lists(st.sampled_from(["a", "é", "[Color:3]", "[Size:12]", "[Ruby:ab|xy]", "[7:300:0AFF]", "[x", "漢"]), max_size=12).map("".join))
def test_message_text_round_trip(text):
    from mosaiq.functions import text as T

    for encoding in (2, 4):
        assert T.decode_text(T.compile_text(text, encoding), encoding) == text
    assert T.units(T.compile_text(text) + b"\0tail") == len(T.compile_text(text))


def test_background_draws_the_image(spark):
    from mosaiq.operators import background as B

    r = random.Random(8)
    colors = [(248, 0, 0), (0, 248, 0), (0, 0, 248), (248, 248, 0), (0, 248, 248), (248, 0, 248)]
    px = [(0, x, y, *colors[(x // 8 + y // 8 * 3 + (x ^ y) % 2) % 6], 255 if r.random() < 0.9 else 0) for x in range(64) for y in range(64)]
    df = spark.createDataFrame(px, "img long, x long, y long, r long, g long, b long, a long")
    cells, chars, palettes = B.generate(df, 4)
    art, drawn = {x.id: x.px for x in chars.collect()}, {}
    for c in cells.collect():
        for pos in range(64):
            i = art[c.raw & 1023][pos ^ (0, 7, 56, 63)[c.raw >> 10 & 3]]
            drawn[c.tile_no % 8 * 8 + pos % 8, c.tile_no // 8 * 8 + pos // 8] = palettes[c.raw >> 12][i][1:] if i else None
    for _, x, y, red, green, blue, a in px:
        got = drawn[x, y]
        assert (got is None) == (a == 0)
        assert got is None or max(abs(p - q) for p, q in zip(got, (red, green, blue), strict=True)) < 30


def test_masked15_is_the_nearest_of_all(spark):
    from mosaiq.operators import background as B

    r = random.Random(9)
    px = spark.createDataFrame([(r.randrange(256), r.randrange(256), r.randrange(256)) for _ in range(60)], "r long, g long, b long")
    every = np.array([(i, j, k) for i in range(32) for j in range(32) for k in range(32)])
    yiq = ((every * 510 + 31) // 62) @ np.array(C.YIQ).T
    for x in B.masked15(px).collect():
        d = ((yiq - np.array([x.r, x.g, x.b]) @ np.array(C.YIQ).T) ** 2).sum(axis=1)
        k = x.color
        assert np.isclose(d.min(), d[(k % 32) * 1024 + (k // 32 % 32) * 32 + k // 1024])


def test_power_of_two_has_no_upper_bound(spark):
    want = {0: 8, 1: 8, 8: 8, 9: 16, 8192: 8192, 8193: 16384, 16384: 16384, 16385: 32768, 1_200_000: 1 << 21, 1 << 40: 1 << 40, (1 << 40) + 1: 1 << 41, 1 << 62: 1 << 62, None: 8}
    got = spark.createDataFrame([(k,) for k in want], "n long").select("n", S.power_of_two(F.col("n")).alias("p"))
    assert got.dtypes[1] == ("p", "bigint") and {r["n"]: r["p"] for r in got.collect()} == want


def test_code_map_runs_merge_as_by_scanning_all_pairs(spark):
    """The same steps as by looking for the best pair anew each time; many runs of one font take little time."""
    r = random.Random(30)

    def scanned(codes):
        own = []
        for k in codes:
            if own and own[-1][1] == k - 1:
                own[-1] = (own[-1][0], k, own[-1][2] + 1)
            else:
                own.append((k, k, 1))
        cost = lambda p, q: D.code_map_cost(p[2] + q[2], q[1] - p[0] + 1)
        alone = lambda p: D.code_map_cost(p[2], p[1] - p[0] + 1)
        while len(own) > 1:
            best, i = max((alone(p) + alone(q) - cost(p, q), i) for i, (p, q) in enumerate(zip(own, own[1:], strict=False)))
            if best < 0:
                break
            own[i : i + 2] = [(own[i][0], own[i + 1][1], own[i][2] + own[i + 1][2])]
        return [(*p, alone(p)) for p in own]

    fonts = {f: sorted(r.sample(range(r.choice((40, 150, 1000))), r.randrange(1, 40))) for f in range(120)}
    stretch = lambda a: range(a, a + r.randrange(1, 60))
    fonts |= {200 + f: sorted({k for _ in range(12) for k in stretch(r.randrange(3000))}) for f in range(60)}
    wide = sorted(r.sample(range(10**6), 20_000))
    merged = lambda c: D.merge_code_runs(D.code_runs(spark.createDataFrame(c, "font long, code long").withColumn("glyph", F.col("code")), "font"), "font")
    got = {}
    for x in merged([(f, k) for f, codes in fonts.items() for k in codes]).collect():
        got.setdefault(x["font"], []).append((x["first"], x["last"], x["n"], x["cost"]))
    assert {f: sorted(x) for f, x in got.items()} == {f: scanned(codes) for f, codes in fonts.items()}
    began = time.time()
    assert sum(x["n"] for x in merged([(1, k) for k in wide]).collect()) == len(wide)
    assert time.time() - began < 30


@pytest.mark.parametrize("most", [4096, 2])
def test_palette_guesses_carry_no_textures(spark, monkeypatch, most):
    """Only palettes are broadcast, and only few; Spark takes the 150,000 textures for less than 10 MB."""
    monkeypatch.setattr(L, "FILE_PALETTES", most, raising=False)
    textures = spark.range(150_000).selectExpr("id", "concat('name', id) AS name", "id % 8 AS fmt", "id % 4 AS highest")
    palettes = spark.createDataFrame([(0, "NAME1", 4), (1, "name2_pl", 4), (2, "other", 8), (3, "none", 2)], "pal long, pal_name string, n_colors long")
    df = L.guess_palettes(textures, palettes)
    got = {x["id"]: (x["pal"], x["rule"]) for x in df.collect()}
    assert len(got) == 150_000 * 7 // 8
    assert got[1] == (0, 1) and got[2] == (1, 2) and got[3] == (1, 7) and all(rule in (6, 7) for k, (_, rule) in got.items() if k > 2)
    joins = set(re.findall(r"Broadcast\w+Join (?:\[(\w+)#.*?)?(Build\w+)", df._jdf.queryExecution().executedPlan().toString()))
    assert joins == ({("key", "BuildRight"), ("", "BuildRight")} if most == 4096 else set())
