from pyspark.sql import functions as F

from pixelflow.operators import decode
from pixelflow.sources import frames

PIXELS = [  # packet, min_ts, x, y, tot, ticks
    (0xB0A3E13482830009, 0, 11, 30, 1000, 2379037),
    (0xAFFFFFFFFFFFFFFF, 17179869184, 255, 255, 25575, 17179869153),
    (0xB000000000150000, 17179869184, 0, 0, 25, 17179869179),
    (0xB021301900A00000, 17179869084, 2, 11, 250, 17179870784),
    (0xB021301900A00000, 51539607557, 2, 11, 250, 51539609152),
]
TRIGGERS = [  # packet, min_ts, ticks, channel, edge
    (0x6F0000000007D020, 0, 12000, 1, 0),
    (0x6A0000000007D000, 0, 11999, 1, 1),
    (0x6E000FFFFFFFFF80, 68719476736, 412316860415, 2, 0),
    (0x6B00000000000A60, 68719476734, 412316860478, 2, 1),
    (0x6C00000000000E40, 0, 85, 0, 0),
]


def signed(p):
    return p - (1 << 64) if p >> 63 else p


def packets(spark, rows):
    return spark.createDataFrame([(signed(r[0]), r[1]) for r in rows], "packet long, min_ts long")


def test_golden_pixels(spark):
    got = decode.pixels(packets(spark, PIXELS)).collect()
    assert [(r.x, r.y, r.tot, r.toa_ticks) for r in got] == [(x, y, tot, t) for _, _, x, y, tot, t in PIXELS]


def test_golden_triggers(spark):
    got = decode.triggers(packets(spark, TRIGGERS)).collect()
    assert [(r.ticks, r.tdc_id, r.edge) for r in got] == [r[2:] for r in TRIGGERS]


def test_other_packets_are_ignored_and_empty_has_a_schema(spark):
    df = packets(spark, [(0x1000000000000000, 0)])
    pixels, triggers = decode.decode(df)
    assert pixels.count() == triggers.count() == 0
    assert pixels.columns == ["x", "y", "toa_ticks", "tot", "toa"] and triggers.columns == ["ticks", "tdc_id", "edge", "toa"]


def test_frames_walk():
    raw = frames.frame_bytes([1, 2], 10, 20)
    found, rest = frames.walk(raw + raw[:16])
    assert [(f[0], f[1], f[2], f[3].tolist()) for f in found] == [(0, 10, 20, [1, 2])] and rest == len(raw)
    five = frames.frame_bytes([7], 1, 2)  # a body of five words holds nothing, but parsing goes on
    found, rest = frames.walk(five + raw)
    assert len(found) == 1 and rest == len(five + raw)
    assert frames.walk(b"\0" * 64) == ([], 0)
    assert frames.split_at_last_frame(raw + raw[:20]) == (raw, raw[:20])


def test_files_to_packets(spark, tmp_path):
    words = [p[0] for p in PIXELS] + [t[0] for t in TRIGGERS]
    (tmp_path / "a.tpx3").write_bytes(frames.frame_bytes(words, 0, 99) + frames.frame_bytes([5, 6], 3, 9))
    got = frames.read(spark, str(tmp_path))
    assert got.count() == len(words) + 2
    assert [signed(w) for w in words] == [r.packet for r in got.filter("frame = 0").orderBy("pos").collect()]
    pixels, triggers = decode.decode(got)
    assert pixels.count() == 5 and triggers.count() == 5
    assert decode.time_range(got).first()[:] == (0, 99)
    assert decode.time_range(got.filter(F.lit(False))).first()[:] == (0, 0)
