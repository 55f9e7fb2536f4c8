import io
import wave
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import signal
from tessera.sources import readers
from tessera.streaming import online


def wav(y, rate=1000):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.asarray(y) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def test_annotations_and_segments(spark, tmp_path):
    (tmp_path / "a.csv").write_text("FileID,Emitter,Addressee,Context,Start sample,End sample\n1,215,0,4,0,300\n1,215,,12,0,300\n2,x,1,4,0,9\n1,7,1,4,0,300\n3,300,1,2,10,20\n1,220,1,3,100,900\n")
    (tmp_path / "f.csv").write_text("FileID,File name,File folder\n1, one.wav ,z1,extra,more\n1,other.wav,z2\n3,three.wav,z1,\n")
    notes = readers.annotations(spark, str(tmp_path / "a.csv"), str(tmp_path / "f.csv"))
    assert sorted((r["file_id"], r["emitter"], r["context_name"]) for r in notes.collect()) == [(1, 215, "Fighting"), (1, 220, "Feeding"), (3, 300, "Biting")]
    (tmp_path / "z").mkdir()
    with zipfile.ZipFile(tmp_path / "z" / "z1.zip", "w") as z:
        z.writestr("d/one.wav", wav(np.sin(np.arange(1000) / 5)))
        z.writestr("three.wav", b"not a wave")
    waves = readers.archived_waves(spark, str(tmp_path / "z"))
    assert {r["file_name"]: r["error"] is None for r in waves.collect()} == {"one.wav": True, "three.wav": False}
    notes = notes.withColumn("file_name", F.lit("one.wav")).where("file_id = 1")
    got = readers.cut(waves, notes).orderBy("pos_segment").collect()
    assert [(r["pos_segment"], len(r["audio"])) for r in got] == [(0, 300), (1, 800)]
    assert got[0]["audio"][5] == pytest.approx(np.sin(1.0), abs=1e-3)


def test_labels_in_paths_and_sinks(spark, tmp_path):
    (tmp_path / "w" / "dog_1").mkdir(parents=True)
    (tmp_path / "w" / "dog_1" / "x_husky_3.wav").write_bytes(b"1")
    assert readers.path_labels(spark, str(tmp_path / "w"), "_([a-z]+)_").first()["label"] == "husky"
    df = spark.createDataFrame([(1, "a")], "n int, s string")
    for kind in ("parquet", "json", "csv", "orc"):
        readers.save(df, str(tmp_path / kind), kind)
    assert spark.read.orc(str(tmp_path / "orc")).collect() == df.collect()
    readers.save(df, str(tmp_path / "md"), "markdown")
    assert [r["value"] for r in spark.read.text(str(tmp_path / "md")).collect()][-1] == "| 1 | a |"


def test_signals():
    t = np.arange(800) / 800
    y = np.sin(2 * np.pi * 20 * t)
    up = signal.resample(y, 800, 1600)
    assert len(up) == 1600 and np.allclose(up[::2], y, atol=1e-6) and np.allclose(signal.resample(up, 1600, 800), y, atol=1e-6)
    both = y + np.sin(2 * np.pi * 300 * t)
    assert np.abs(signal.band_pass(both, 800, 5, 60) - y)[100:-100].max() < 0.1
    m = signal.log_mel(y, 800, 16, 128, 32)
    assert m.max() == pytest.approx(0) and m.min() >= -120 and signal.squashed(m, 6, 32).shape == (6, 32)
    assert signal.mfcc(y, 800, 5, width=128, hop=32, bands=16).shape[1] == 5
    burst = np.zeros(2000)
    burst[300:500], burst[1200:1500] = 1, 1
    got = signal.segments(burst, 800)
    assert len(got) == 2 and abs(got[0][0] - 300) < 40 and abs(got[1][1] - 1500) < 40
    assert signal.segments(np.zeros(10), 800) == [(0, 10)] and signal.segments(np.zeros(0), 800) == []


def test_segments_of_rows(spark):
    burst = [0.0] * 300 + [1.0] * 200 + [0.0] * 700 + [1.0] * 300 + [0.0] * 100
    rows = spark.createDataFrame([(1, burst), (2, [])], "id long, y array<double>")
    assert [r["id"] for r in signal.segmented(rows, "y", 800).collect()] == [1, 1]
    emb = signal.embedded(rows, "y", lambda xs: np.array([[len(x), 1.0] for x in xs]), 2).collect()
    assert emb[0]["embedding"] == [1600.0, 1.0]


def test_streams(spark, tmp_path):
    base = "/root/testdata/sf0.001/events.parquet"
    events = spark.read.parquet(base)
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    for name, df, mode in (("counts", online.token_counts(stream), "complete"), ("sess", online.sessions(stream), "complete")):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
        q.processAllAvailable()
        q.stop()
    assert spark.table("counts").agg(F.sum("n")).first()[0] == events.count() == spark.table("sess").agg(F.sum("n")).first()[0]
