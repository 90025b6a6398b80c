import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from likeness.sources import files, sinks, tables
from likeness.streaming.incremental import pending, replace_parts


def npy(array):
    b = io.BytesIO()
    np.save(b, array)
    return b.getvalue()


def wav(samples, bits=16, channels=1, rate=48000, tag=1):
    x = np.asarray(samples, float).reshape(-1, channels)
    if tag == 3:
        data = x.astype("<f4").tobytes()
    elif bits == 24:
        i = (x * (1 << 23)).astype("<i4")
        data = i.reshape(-1, 1).view("u1").reshape(-1, 4)[:, :3].tobytes()
    else:
        data = (x * (1 << 15)).astype("<i2").tobytes()
    frame = channels * bits // 8
    head = (np.array([tag, channels], "<u2").tobytes() + np.array([rate, rate * frame], "<u4").tobytes()
            + np.array([frame, bits], "<u2").tobytes())
    body = b"WAVEfmt " + (16).to_bytes(4, "little") + head + b"data" + len(data).to_bytes(4, "little") + data
    body += b"\x00" * (len(data) % 2)
    return b"RIFF" + len(body).to_bytes(4, "little") + body


def put(root, name, content):
    p = root / name
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(p)


@pytest.fixture
def vector_tree(tmp_path):
    a = "old/1___alpha-ag/single/c1_alpha.npy"
    put(tmp_path, a, npy(np.zeros(4, "f4")))
    put(tmp_path, "new/2___alpha-ag/single/c1_alpha.npy", npy(np.ones((2, 4), "f4")))
    put(tmp_path, "new/2___alpha-ag/other/c2_alpha.npy", npy(np.array([1, np.nan, 0, 0], "f4")))
    put(tmp_path, "new/2___alpha-ag/other/c3_alpha.npy", b"not numpy")
    put(tmp_path, "new/2___be_ta-ag/x/c1_be_ta.npy", npy(np.ones((1, 3), "f4")))
    put(tmp_path, "new/2___be_ta-ag/x/c4_be_ta.npy", npy(np.ones((1, 2, 2), "f4")))
    return [str(tmp_path / "old"), str(tmp_path / "new")]


def test_later_root_owns_the_model(spark, vector_tree):
    got = {r.model: r.dir for r in files.model_dirs(spark, vector_tree).collect()}
    assert set(got) == {"alpha", "be_ta"} and got["alpha"].endswith("/new/2___alpha-ag")


def test_vectors_and_unreadable_files(spark, vector_tree):
    rows = files.read_vectors(spark, vector_tree).collect()
    ok = [(r.model, r.item, r.window, r.single) for r in rows if r.error is None]
    assert sorted(ok) == [("alpha", "c1", 0, True), ("alpha", "c1", 1, True), ("alpha", "c2", 0, False), ("be_ta", "c1", 0, False)]
    assert sorted(r.item for r in rows if r.error) == ["c3", "c4"]


def test_identity_frame(spark, vector_tree, tmp_path):
    header = "original_stem,bird,recording_id,kind,call_type,sibling_group,environment_class\n"
    path = put(tmp_path, "master.csv", header + "c1,Ada,r1,repeated,x,f1,lab\nc2,Bo,r2,,x,none,lab\nc4,Cy,NA,single,x,,lab\n")
    master = tables.read_master(spark, path)
    assert master.filter("original_stem = 'c4'").first().recording_id is None
    v = files.read_vectors(spark, vector_tree)
    w = files.identity_frame(v, master).collect()
    assert sorted((r.model, r.item, r.window, r.ind, r.kind) for r in w) == [
        ("alpha", "c1", 0, "ada", "single"), ("alpha", "c1", 1, "ada", "single"), ("be_ta", "c1", 0, "ada", "single")]
    bad = v.withColumn("v", F.when(F.col("window") == 1, F.array(F.lit(float("inf")))).otherwise(F.col("v")))
    assert {r.model for r in files.identity_frame(bad, master, "item").collect()} == {"be_ta"}


def test_inventory(spark, vector_tree):
    inv = files.inventory(spark, vector_tree[1], "*.npy", min_bytes=20).collect()
    assert len(inv) == 4 and all(len(r.md5) == 32 and len(r.sha256) == 64 for r in inv)


@pytest.mark.parametrize("bits,tag", [(16, 1), (24, 1), (32, 3)])
@pytest.mark.parametrize("channels", [1, 2])
def test_padding_keeps_format_and_prefix(spark, tmp_path, bits, tag, channels):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(14400, channels)) * 0.1
    source = wav(x, bits, channels, tag=tag)
    put(tmp_path, "a.wav", source)
    scan = files.scan(spark, str(tmp_path), "*.wav")
    r = files.pad_audio(scan, 1.0).first()
    out = bytes(r.content)
    assert r.added == 48000 - 14400
    assert files._header(out)[:4] == files._header(source)[:4]
    old, new = files._samples(source), files._samples(out)
    assert new.shape == (channels, 48000) and np.array_equal(new[:, :14400], old) and not new[:, 14400:].any()
    assert np.allclose(old, x.T, atol=2e-4)
    got = files.read_audio(scan).first()
    assert got.rate == 48000 and np.allclose(np.array(got.channels), old)


def test_long_audio_is_byte_identical(spark, tmp_path):
    source = wav(np.zeros(72000), 24)
    put(tmp_path, "a.wav", source)
    r = files.pad_audio(files.scan(spark, str(tmp_path), "*.wav"), 1.0).first()
    assert r.added == 0 and bytes(r.content) == source


def test_audio_status(spark, tmp_path):
    put(tmp_path, "ok.wav", wav(np.zeros(10)))
    put(tmp_path, "none.wav", wav(np.zeros(0)))
    put(tmp_path, "zero.wav", b"")
    put(tmp_path, "bad.wav", b"RIFFxxxxnope")
    got = {r.path.split("/")[-1]: r.status for r in files.audio_status(files.scan(spark, str(tmp_path), "*.wav")).collect()}
    assert got == {"ok.wav": "ok", "none.wav": "empty", "zero.wav": "empty", "bad.wav": "unreadable"}


def test_pad_outcome_and_first_hit(spark):
    items = spark.createDataFrame([("d", p) for p in "abcde"], "dataset string, path string")
    one = lambda ps: spark.createDataFrame([(p,) for p in ps], "path string")
    padded = spark.createDataFrame([("a", 5), ("b", 0)], "path string, added long")
    r = files.pad_outcome(items, one("abc"), one("c"), padded).first()
    assert (r.padded, r.copied, r.present, r.missing) == (1, 1, 1, 2)
    first = spark.createDataFrame([("a", "x/a")], "path string, location string")
    second = spark.createDataFrame([("a", "y/a"), ("b", "y/b")], "path string, location string")
    got = {r.path: r.location for r in files.first_hit(items, first, second).collect()}
    assert got == {"a": "x/a", "b": "y/b", "c": None, "d": None, "e": None}


def test_clips_with_audio_requires_every_file(spark):
    m = spark.createDataFrame([("i1", "r1", "single", "a"), ("i2", "r1", "repeated", "b")],
                              "original_stem string, recording_id string, kind string, rel_audio_path string")
    audio = spark.createDataFrame([("a", 1)], "path string, rate int")
    assert files.clips_with_audio(m, audio).count() == 1
    with pytest.raises(ValueError, match="1 item"):
        files.clips_with_audio(m, audio.filter("path = 'z'"))


def test_small_tables(spark, tmp_path):
    assert tables.model_panel(spark).count() == 18
    path = put(tmp_path, "CHECKSUMS.csv", "a.wav,10,abc\n")
    assert tables.read_checksums(spark, path).first().md5 == "abc"
    assert tables.read_checksums(spark, str(tmp_path / "none.csv")).count() == 0
    m = put(tmp_path, "m.csv", "x,y\n1,2\n")
    assert tables.read_combined(spark, m, str(tmp_path / "no.csv")) is None
    n = put(tmp_path, "n.csv", "x,z\n3,4\n")
    assert [r.asDict() for r in tables.read_combined(spark, m, n).orderBy("x").collect()] == [
        {"x": "1", "y": "2", "z": None}, {"x": "3", "y": None, "z": "4"}]
    df = spark.createDataFrame([("birdnet",)], "model string")
    with pytest.raises(ValueError, match="nope"):
        tables.restrict_to_panel(df, ["birdnet", "nope"], tables.model_panel(spark))


def test_run_record_round_trip(spark, tmp_path):
    path = str(tmp_path / "runs")
    sinks.start_run(spark, path, "r1", {"analysis": "e1", "extraction": "e2"}, "c1", "0-6")
    r = tables.read_runs(spark, path).select(F.col("env_hash")["extraction"].alias("x"), "run_id", "allow_env_drift").first()
    assert (r.x, r.run_id, r.allow_env_drift) == ("e2", "r1", False)
    sinks.write_provenance(spark, str(tmp_path / "prov"), "alpha", "r1", "e2", "c1")
    assert tables.read_record(spark, str(tmp_path / "prov")).first().env_hash == "e2"


def test_replace_parts(spark, tmp_path):
    path = str(tmp_path / "parts")
    replace_parts(spark.createDataFrame([("a", 1), ("b", 2)], "model string, x int"), path)
    replace_parts(spark.createDataFrame([("b", 3)], "model string, x int"), path, emptied=["a"])
    assert [(r.model, r.x) for r in tables.read_parts(spark, path).collect()] == [("b", 3)]


def test_pending(spark):
    work = spark.createDataFrame([("a", 1), ("b", 1)], "m string, s int")
    assert pending(work, None, ["m", "s"]).count() == 2
    assert [r.m for r in pending(work, work.filter("m = 'a'"), ["m", "s"]).collect()] == ["b"]


def test_csv_and_wide_sinks(spark, tmp_path):
    df = spark.createDataFrame([("i", [1.0, 2.0])], "item string, v array<double>")
    w = sinks.wide_vectors(df, 2)
    assert w.columns == ["item", "e0", "e1"]
    sinks.write_table(w, str(tmp_path / "t"))
    assert spark.read.csv(str(tmp_path / "t"), header=True).first().e1 == "2.0"
    f = df.withColumns({"dataset": F.lit("d"), "model": F.lit("m")})
    sinks.write_features(f, str(tmp_path / "f"))
    assert spark.read.parquet(str(tmp_path / "f")).filter("model = 'm'").count() == 1


def test_wide_vectors_refuse_other_lengths(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("b", None)], "item string, v array<double>")
    assert [tuple(r) for r in sinks.wide_vectors(df, 2).orderBy("item").collect()] == [("a", 1.0, 2.0), ("b", None, None)]
    with pytest.raises(Exception, match="expected 3 components, found 2"):
        sinks.wide_vectors(df, 3).collect()


def test_unreadable_audio_is_reported_not_fatal(spark, tmp_path):
    put(tmp_path, "ok.wav", wav(np.zeros(10)))
    put(tmp_path, "bad.wav", b"RIFFxxxxnope")
    scan = files.scan(spark, str(tmp_path), "*.wav")
    read = {r.path.split("/")[-1]: r for r in files.read_audio(scan).collect()}
    assert read["ok.wav"].error is None and read["bad.wav"].channels is None and "ValueError" in read["bad.wav"].error
    padded = {r.path.split("/")[-1]: r for r in files.pad_audio(scan, 1.0).collect()}
    assert padded["ok.wav"].added > 0 and padded["bad.wav"].content is None and "ValueError" in padded["bad.wav"].error


def test_long_vector_files_come_in_several_batches(spark, tmp_path, monkeypatch):
    import io

    monkeypatch.setattr(files, "DECODED_ROWS", 3)
    m, out = np.arange(20, dtype="float32").reshape(10, 2), io.BytesIO()
    np.save(out, m)
    rows = list(files._decode([__import__("pyarrow").RecordBatch.from_pydict({"path": ["a", "b"], "content": [out.getvalue(), b"no"]})]))
    assert [b.num_rows for b in rows] == [3, 3, 3, 1, 1]
    assert np.array_equal(np.array([v for b in rows[:4] for v in b.column(2).to_pylist()]), m)
    assert rows[-1].column(3)[0].as_py() is not None
