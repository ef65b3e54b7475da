"""The splittable audio source against whole files."""

import struct
import wave

import numpy as np
import pytest

from jatoba.operators import speakers
from jatoba.sources import audio


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("wav")
    rng = np.random.default_rng(1)
    for name, channels, n in (("a", 1, 50_123), ("b", 2, 33_000), ("c", 1, 399), ("d", 1, 0)):
        with wave.open(f"{d}/{name}.wav", "wb") as w:
            w.setnchannels(channels)
            w.setsampwidth(2)
            w.setframerate(16_000)
            w.writeframes((rng.normal(0, 3000, n * channels)).astype("<i2").tobytes())
    raw = open(f"{d}/a.wav", "rb").read()
    # a chunk of odd length before the samples, and a size left open
    with open(f"{d}/e.WAV", "wb") as f:
        f.write(raw[:36] + b"LIST" + struct.pack("<I", 5) + b"hello\0" + b"data" + struct.pack("<I", 0xFFFFFFFF) + raw[44:])
    open(f"{d}/notes.txt", "w").write("no audio")
    return str(d)


def whole(path):
    with wave.open(path.replace("e.WAV", "a.wav")) as w:
        x = np.frombuffer(w.readframes(w.getnframes()), "<i2").astype(np.float32) / 32768
        return x.reshape(-1, w.getnchannels()).mean(1)


@pytest.mark.parametrize(("range_s", "block_s"), [(600, 30), (1, 0.3), (0.02, 0.001), (0.7, 600)])
def test_samples_and_features_of_ranges_are_those_of_the_file(folder, range_s, block_s):
    for kind in ("samples", "mfcc"):
        reader = audio.WavReader({"path": folder, "as": kind, "range_s": range_s, "block_s": block_s})
        got: dict = {}
        for p in reader.partitions()[::-1]:  # in any order
            for batch in reader.read(p):
                for r in batch.to_pylist():
                    got.setdefault(r["path"].rsplit("/", 1)[-1], []).append((r["start"] if kind == "samples" else r["frame"], r["samples"] if kind == "samples" else r["c"]))
                    assert kind == "mfcc" or len(r["samples"]) <= max(1, round(block_s * 16_000))
        for name in ("a.wav", "b.wav", "c.wav", "e.WAV"):
            x = whole(f"{folder}/{name}")
            rows = sorted(got.get(name, []))
            if kind == "samples":
                assert np.array_equal(np.concatenate([v for _, v in rows]).astype(np.float32), x)
            else:
                want = speakers.mfcc(x)
                assert [f for f, _ in rows] == list(range(len(want))) and (not len(want) or np.allclose([c for _, c in rows], want, atol=1e-9))
        assert "d.wav" not in got


def test_source_in_spark(spark, folder):
    df = audio.read(spark, [f"{folder}/a.wav", f"{folder}/b*"], "mfcc", range_s=0.5)
    assert df.rdd.getNumPartitions() > 6
    rows = {(r["path"].rsplit("/", 1)[-1], r["frame"]): r["c"] for r in df.collect()}
    want = speakers.mfcc(whole(f"{folder}/a.wav"))
    assert np.allclose([rows["a.wav", i] for i in range(len(want))], want) and len(rows) == len(want) + len(speakers.mfcc(whole(f"{folder}/b.wav")))
    assert audio.read(spark, f"{folder}/none*").count() == 0


def test_names_patterns_and_folders(folder):
    named = lambda *p: [x.rsplit("/", 1)[-1] for x in audio.expand([f"{folder}{q}" for q in p], ("wav",))]
    assert named("") == ["a.wav", "b.wav", "c.wav", "d.wav", "e.WAV"] == named("/")
    assert named("/[ab].wav", "/a.wav", "/notes.txt", "/missing.wav") == ["a.wav", "b.wav", "notes.txt", "missing.wav"]
    assert named("/*.txt") == [] and audio.expand([f"file://{folder}/a.*"], ("wav",)) == [f"file://{folder}/a.wav"]
    with pytest.raises(ValueError, match="no WAV"):
        audio.WavReader({"path": f"{folder}/notes.txt"}).partitions()
