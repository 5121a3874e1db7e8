from __future__ import annotations

import struct
import wave as standard

from loomstone.sources import wave as W


def _format(channels, rate, bits):
    return struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits)


def _file(*chunks):
    body = b"WAVE" + b"".join(chunks)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def test_headers_of_files_of_every_kind(spark, tmp_path):
    long = b"LIST" + struct.pack("<I", 100_001) + b"x" * 100_002  # of odd size: a byte is added
    data = lambda n: b"data" + struct.pack("<I", n) + b"\0" * n
    files = {
        "plain": _file(_format(1, 8000, 16), data(16_000)), "stereo": _file(long, _format(2, 44_100, 24), long, data(6 * 44_100)), "empty_data": _file(_format(1, 8000, 16), data(0)),
        "none": b"", "text": b"not a sound at all", "cut": _file(_format(1, 8000, 16))[:30], "no_format": _file(data(8)), "no_data": _file(_format(1, 8000, 16)), "zero_rate": _file(_format(1, 0, 16), data(4)),
    }
    (tmp_path / "deep").mkdir()
    for k, (name, content) in enumerate(files.items()):
        ((tmp_path / "deep" if k % 2 else tmp_path) / f"{name}.wav").write_bytes(content)
    (tmp_path / "other.bin").write_bytes(files["plain"])
    for each in (1, 4, 256):
        got = {r.path.rsplit("/", 1)[1][:-4]: r for r in W.read_headers(spark, f"file://{tmp_path}", each).collect()}
        assert got.keys() == files.keys()
        assert (got["plain"].seconds, got["plain"].bits, got["plain"].bytes_read) == (1.0, 16, 44)
        assert (got["stereo"].seconds, got["stereo"].channels, got["stereo"].rate) == (1.0, 2, 44_100) and got["stereo"].bytes_read < 100 < got["stereo"].length
        assert got["empty_data"].seconds == 0
        for name in ("none", "text", "cut", "no_format", "no_data", "zero_rate"):
            assert got[name].seconds is None and got[name].error
    (tmp_path / "nothing").mkdir()
    assert W.read_headers(spark, f"{tmp_path}/nothing").collect() == []


def test_written_files_are_read_by_others(spark, tmp_path):
    rows = spark.createDataFrame([("a", [0.0, 0.5, -1.0, 2.0, None, float("nan")], 8000), ("b", [], 16_000), ("c", None, 8000)], "n string, x array<double>, r int")
    assert sorted((r.name, r.frames) for r in W.write_waves(rows, f"file://{tmp_path}/out", "n", "x", "r").collect()) == [("a", 6), ("b", 0), ("c", 0)]
    with standard.open(str(tmp_path / "out" / "a.wav")) as f:
        assert (f.getnchannels(), f.getsampwidth(), f.getframerate()) == (1, 2, 8000)
        assert struct.unpack("<6h", f.readframes(6)) == (0, 16383, -32767, 32767, 0, 0)
    assert {r.path[-5]: r.seconds for r in W.read_headers(spark, f"{tmp_path}/out").collect()} == {"a": 6 / 8000, "b": 0.0, "c": 0.0}
