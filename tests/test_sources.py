import io
import os
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnloom.functions import audio, hooks
from turnloom.sources import archives, files
from turnloom.streaming import replay


def _tar(path, members):
    with tarfile.open(path, "w") as tar:
        for name, content in members:
            info = tarfile.TarInfo(name)
            info.size = len(content)
            tar.addfile(info, io.BytesIO(content))


def test_archives(spark, tmp_path):
    pcm = np.arange(48_001 * 2, dtype="<i2").tobytes()
    good = archives.pcm16_wav(pcm, 48_000)
    _tar(tmp_path / "a.tar", [("x/one.wav", good), ("x/two.wav", b"RIFF"), ("x/note.txt", b"-"), ("y/one.wav", good)])
    _tar(tmp_path / "b.tar", [("one.json", b"{}"), ("other.json", b"{}")])
    wavs, meta = archives.read_tar(spark, str(tmp_path), ".wav"), archives.read_tar(spark, str(tmp_path), ".json")
    assert wavs.count() == 3 and [tuple(r) for r in archives.repeated_stems(wavs).collect()] == [("one", 2)]
    pairs, orphans = archives.paired_members(wavs.dropDuplicates(["stem"]), meta)
    assert [r["stem"] for r in pairs.collect()] == ["one"] and [r["stem"] for r in orphans.collect()] == ["two"]
    read = {r["stem"]: r for r in archives.read_wav(wavs.dropDuplicates(["stem"])).collect()}
    assert (read["one"]["rate"], read["one"]["frames"], read["one"]["chunk_count"], read["one"]["pcm"]) == (48_000, 96_002, 13, pcm)
    assert read["two"]["error"] and read["two"]["pcm"] is None


def test_audio(spark):
    assert len(audio.third_rate(np.zeros(48_001, np.int16))) == 16_001 and len(audio.third_rate(np.zeros(0, np.int16))) == 0
    tone = (10_000 * np.sin(2 * np.pi * 440 * np.arange(48_000) / 48_000)).astype(np.int16)
    low = audio.third_rate(tone)
    assert np.abs(low[100:-100] - tone[::3][100:-100]).max() < 200
    padded, n = audio.pad_to_chunk(np.ones(2561, np.int16))
    assert (len(padded), n) == (5120, 2559)
    parts = audio.segments(np.arange(31 * 16_000))
    assert [len(p) for p in parts] == [480_000, 16_000]
    stereo = np.stack([tone, -tone], 1).astype("<i2").tobytes()
    df = spark.createDataFrame([("v", stereo, 2, 1), ("n", None, 2, 0)], "view_id string, pcm binary, channels int, target int")
    got = {r["view_id"]: r for r in audio.target_audio(df).collect()}
    assert (got["v"]["frames"], got["v"]["padding"], len(got["v"]["audio"])) == (16_000, 1_920, 35_840) and got["n"]["audio"] is None


def test_files(spark, tmp_path):
    path = str(tmp_path / "in.jsonl")
    with open(path, "w") as f:
        f.write('{"b": 1, "a": "x"}\n\n{"b": 2}\n')
    df = files.read_jsonl(spark, path, "b int, a string")
    assert df.count() == 2
    target = str(tmp_path / "out")
    files.publish(spark, target, lambda folder: files.write_jsonl(df.coalesce(1), folder))
    text = "".join(open(os.path.join(target, n)).read() for n in os.listdir(target) if n.endswith(".json"))
    assert text.splitlines() == ['{"a":"x","b":1}', '{"a":null,"b":2}']
    with pytest.raises(FileExistsError):
        files.publish(spark, target, lambda folder: None)

    def fail(folder):
        files.write_parquet(df, folder)
        raise ValueError

    with pytest.raises(ValueError):
        files.publish(spark, str(tmp_path / "bad"), fail)
    assert not [n for n in os.listdir(tmp_path) if n.startswith("bad")]


def test_checksums_and_lists(spark, tmp_path):
    os.makedirs(tmp_path / "d/sub")
    for name, content in (("a.txt", "1"), ("sub/b.txt", "2")):
        (tmp_path / "d" / name).write_text(content)
    folder = str(tmp_path / "d")
    kept = spark.createDataFrame(files.inventory(spark, folder).select("path", "sha256").collect())
    assert [r[0].split("  ")[1] for r in files.checksum_lines(kept).collect()] == ["a.txt", "sub/b.txt"]
    (tmp_path / "d/a.txt").write_text("changed")
    (tmp_path / "d/c.txt").write_text("new")
    bad = {tuple(r) for r in files.checksum_faults(spark, kept.union(kept.filter("path like 'sub%'")), folder).collect()}
    assert bad == {("a.txt", "changed"), ("c.txt", "unnamed"), ("sub/b.txt", "repeated")}
    listed = tmp_path / "list.jsonl"
    listed.write_text('{"wav": "./b.wav"}\n\n{"wav": "/a.wav"}\n{"wav": "x/../a.wav"}\n{}\n')
    assert [(r["path"], r["safe"]) for r in files.read_listed(spark, str(listed)).orderBy("place").collect()] == [("./b.wav", True), ("/a.wav", False), ("x/../a.wav", False), (None, False)]


def test_hooks(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "k string")
    kept = spark.createDataFrame([("a", 7)], "k string, n bigint")
    got = hooks.with_cached_model(rows, kept, "k", lambda: lambda pdf: pdf.assign(n=1))
    assert sorted(tuple(r) for r in got.collect()) == [("a", 7), ("b", 1)]
    tries = []

    def call(x):
        tries.append(x)
        if len(tries) < 3:
            raise OSError("busy")
        return "ok"

    assert hooks.retried(call)("q") == ("ok", None) and len(tries) == 3
    assert hooks.retried(lambda x: 1 / 0, tries=2)("q")[1].startswith("ZeroDivisionError")


def test_stream_equals_batch(spark, tmp_path):
    df = spark.range(500).select((F.col("id") % 3).cast("string").alias("k"), F.timestamp_seconds(F.col("id") * 37).alias("ts"), F.col("id").cast("double").alias("value"))
    df.repartition(3).write.parquet(str(tmp_path / "t.parquet"))
    batch = replay.tumbling(spark.read.parquet(str(tmp_path / "t.parquet")), "ts", "10 minutes", ["k"])
    stream = replay.replayed_tumbling(spark, str(tmp_path / "t.parquet"), "ts", "10 minutes", ["k"])
    assert sorted(map(tuple, batch.collect())) == sorted(map(tuple, stream.collect()))
    seen = replay.first_seen(replay.stream_of(spark, str(tmp_path / "t.parquet")), ["k"], "ts", "1 day")
    q = seen.writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select * from seen").count() == 3
    timely, late = replay.split_late(df.withColumn("arrived", F.col("ts") + F.expr("make_interval(0, 0, 0, 0, 0, 0, value)")), "ts", "arrived", "100 seconds")
    assert (timely.count(), late.count()) == (101, 399)


def test_discovery(spark, tmp_path):
    for name in ("complete/b.wav", "complete/a.wav", "incomplete/c.wav", "complete/x.txt"):
        os.makedirs(tmp_path / "set" / os.path.dirname(name), exist_ok=True)
        (tmp_path / "set" / name).write_text("x")
    found = files.walked(spark, str(tmp_path / "set"))
    assert [(r["place"], r["path"]) for r in found.orderBy("place").collect()] == [(0, "complete/a.wav"), (1, "complete/b.wav"), (2, "incomplete/c.wav")]
    bad = files.discovery_faults(found.union(found.filter("place = 0")), "complete", 3)
    assert sorted(map(tuple, bad.collect())) == [("4", "number"), ("complete/a.wav", "repeated"), ("incomplete/c.wav", "label")]
    long = tmp_path / "long.jsonl"
    long.write_text("".join(f'{{"wav": "w{i}"}}\n' for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        got = files.read_listed(spark, str(long))
        assert got.rdd.getNumPartitions() > 0 and [r["path"] for r in got.orderBy("place").collect()] == [f"w{i}" for i in range(3000)]
        assert [r["place"] for r in got.orderBy("place").collect()] == list(range(3000))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_replacing_requests_and_secrets(spark, tmp_path):
    df, target = spark.range(3), str(tmp_path / "t")
    files.replace(spark, target, lambda folder: files.write_parquet(df, folder))
    files.replace(spark, target, lambda folder: files.write_parquet(df.filter("id > 0"), folder))
    assert spark.read.parquet(target).count() == 2 and sorted(os.listdir(tmp_path)) == ["t"]

    def fail(folder):
        raise ValueError

    with pytest.raises(ValueError):
        files.replace(spark, target, fail)
    assert spark.read.parquet(target).count() == 2
    (tmp_path / "one.json").write_text('{\n "a": 1}')
    (tmp_path / "many.jsonl").write_text('{"a": 1}\n{"a": 2}\n')
    assert [files.read_requests(spark, str(tmp_path / n), "a int").count() for n in ("one.json", "many.jsonl")] == [1, 2]
    secret = tmp_path / ".env"
    secret.write_text('# x\nOTHER=1\nKEY = "v=1"\n')
    secret.chmod(0o644)
    with pytest.raises(PermissionError):
        files.read_secret(str(secret), "KEY")
    secret.chmod(0o600)
    assert files.read_secret(str(secret), "KEY") == "v=1"
    with pytest.raises(KeyError):
        files.read_secret(str(secret), "NONE")


def test_large_file_is_read_in_blocks(spark, tmp_path):
    import hashlib

    content = os.urandom(100_000)
    (tmp_path / "big.bin").write_bytes(content)
    assert [tuple(r) for r in files.inventory(spark, str(tmp_path), block=4_096).collect()] == [("big.bin", 100_000, hashlib.sha256(content).hexdigest())]


def test_mono_samples(spark):
    import numpy as np

    from turnloom.functions import audio

    samples = np.array([0, 16_384, -32_768], "<i2")
    wav = archives.pcm16_wav(samples.tobytes())
    assert archives.mono_float(wav).tolist() == [0.0, 0.5, -1.0] and archives.mono_float(wav).dtype == np.float32
    with pytest.raises(ValueError):
        archives.mono_float(archives.pcm16_wav(samples.tobytes(), 8_000))
    pcm = np.arange(9_600, dtype="<i2").tobytes()
    made = audio.target_audio(spark.createDataFrame([("v", pcm, 2, 1), ("n", None, 2, 0)], "view_id string, pcm binary, channels int, target int"))
    got = {r["view_id"]: r for r in audio.audio_manifest(made).collect()}
    assert (got["v"]["frames"], got["v"]["padded_frames"], got["v"]["chunk_count"], got["n"]["chunk_count"]) == (1_600, 2_560, 1, 0)
    assert len(got["v"]["signature"]) == 64 and got["n"]["audio_sha256"] is None


def test_remote_rules():
    log = []

    def call(error):
        def run(request):
            log.append(request)
            raise error

        return run

    assert hooks.retried(call(hooks.Refused(503)), 3, again=hooks.may_pass)("q")[1] == "Refused: 503" and len(log) == 3
    assert hooks.retried(call(hooks.Refused(400, "no")), 3, again=hooks.may_pass)("q")[1] == "Refused: 400 no" and len(log) == 4
    asked = []
    answer = hooks.corrected(lambda q: asked.append(q) or ("good" if "bad answer" in q else "bad"), lambda a: [] if a == "good" else ["bad answer"])("q")
    assert answer == ("good", 2, []) and asked[1].startswith("q\n")
    assert hooks.corrected(lambda q: "bad", lambda a: ["x"], 2)("q") == (None, 2, ["x"])
    heard = hooks.with_fallback(lambda x: "" if x else 1 / 0)
    assert heard(1) == ("", "no text") and heard(0)[1].startswith("ZeroDivisionError")
    once = hooks.Remembered(lambda b: b.decode().upper(), "m")
    assert [once(b"a"), once(b"b"), once(b"a")] == ["A", "B", "A"] and [hit for _, _, hit in once.calls] == [False, False, True]


def test_formats_reports_and_identities(spark, capsys, tmp_path):
    import hashlib

    from turnloom import __main__ as command
    from turnloom.functions import formats, hashing
    from turnloom.sources import reports

    df = spark.createDataFrame([(1234.5, {"a": 1, "b": 2}, {"b": 3}, "hi 👩‍🏫!", [3.0, 4.0, None])], "x double, m map<string,int>, o map<string,int>, t string, v array<double>")
    got = df.select(formats.fixed(F.col("x"), 2), formats.merged(F.col("m"), F.col("o")), formats.merged(F.lit(None).cast("map<string,int>"), F.col("o")), formats.without_emoji(F.col("t")), formats.l2_norm(F.col("v"))).first()
    assert tuple(got) == ("1234.50", {"a": 1, "b": 3}, {"b": 3}, "hi !", 5.0)
    table = spark.createDataFrame([("a|b", 0.12345, None)], "k string, v double, n int")
    assert reports.markdown_table(table) == "| k | v | n |\n|---|---|---|\n| a\\|b | 0.123 | — |"
    assert "<td>a|b</td><td>0.12</td>" in reports.html_table(table, 2)
    with pytest.raises(ValueError):
        reports.markdown_table(spark.range(5), most=4)
    files_ = [(i, f"p{i}", i, "s") for i in range(2000)]
    lines = [hashlib.sha256(f"p{i}\n{i}\ns".encode()).hexdigest() for i in range(2000)]
    parts = [hashlib.sha256("".join(lines[a : a + 1024]).encode()).hexdigest() for a in (0, 1024)]
    identity = hashing.inventory_identity(spark.createDataFrame(files_, "place bigint, path string, size bigint, sha256 string").orderBy(F.rand(1)))
    assert identity.first()[0] == hashlib.sha256("".join(parts).encode()).hexdigest()
    maps = spark.createDataFrame([({"b": "2", "a": "1"},)], "m map<string,string>")
    assert maps.select(hashing.map_signature(F.col("m"))).first()[0] == hashlib.sha256(b'{"a":"1","b":"2"}').hexdigest()
    key = maps.select(hashing.buffer_key(F.lit("id"), F.lit(16000), F.lit("<i2"), F.lit("[1]"), F.lit(bytearray(b"\x00\x01")))).first()[0]
    assert key == hashlib.sha256(b"id\n16000\n<i2\n[1]\n\x00\x01").hexdigest()
    assert formats.git_identity(str(tmp_path))["commit"] == ""
    with pytest.raises(SystemExit):
        command.main(["source_summary", "x", "--out", "y", "--report"])
