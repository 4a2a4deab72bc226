import hashlib
import json

import pytest
import zstandard
from pyspark.sql import functions as F

from lodestar.plans import publish
from lodestar.sources import archive, units
from lodestar.streaming import ingest


def write(path, *frames):
    path.write_bytes(b"".join(zstandard.ZstdCompressor().compress(f) for f in frames))
    return str(path)


def sources(spark, *paths):
    return archive.register(spark, [{"source_id": f"s{k}", "path": p, "source_kind": "submission", "declared_month": "2026-01"} for k, p in enumerate(paths)])


def test_frames_lines_and_quarantine(spark, tmp_path):
    a = write(tmp_path / "a.jsonl.zst", b'{"id":"1"}\n', b'not-json\n{"id":"3"}\n[4]')
    (tmp_path / "b.jsonl").write_bytes(b"".join(b'{"id":"%d"}\n' % k for k in range(5000)))
    reg = sources(spark, a, str(tmp_path / "b.jsonl"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        got = archive.quarantined(archive.scan(spark, reg)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    first = sorted((r["line_number"], r["raw_line"], r["problem"]) for r in got if r["source_id"] == "s0")
    assert first == [(1, '{"id":"1"}', None), (2, "not-json", "invalid_json"), (3, '{"id":"3"}', None), (4, "[4]", "not_an_object")]
    assert sorted((r["line_number"], json.loads(r["raw_line"])["id"]) for r in got if r["source_id"] == "s1") == [(k + 1, str(k)) for k in range(5000)]
    stats = {r["source_id"]: r for r in archive.reader_stats(archive.quarantined(archive.scan(spark, reg))).collect()}
    assert stats["s0"]["invalid_line_numbers"] == [2, 4] and not stats["s0"]["complete"] and stats["s1"]["complete"]


def test_broken_frames_and_checksums(spark, tmp_path):
    whole = zstandard.ZstdCompressor().compress(b'{"id":"1"}\n' * 2000)
    (tmp_path / "cut.jsonl.zst").write_bytes(whole[: len(whole) // 2])
    good = write(tmp_path / "good.jsonl.zst", b'{"id":"1"}\n')
    reg = sources(spark, str(tmp_path / "cut.jsonl.zst"), good)
    wrong = reg.withColumn("expected_checksum", F.when(F.col("source_id") == "s1", "0" * 64))
    assert [r["status"] for r in archive.validate(spark, reg).orderBy("source_id").collect()] == ["failed", "complete"]
    assert [r["status"] for r in archive.validate(spark, wrong).orderBy("source_id").collect()] == ["failed", "failed"]
    assert archive.checksum(spark, good) == hashlib.sha256((tmp_path / "good.jsonl.zst").read_bytes()).hexdigest()


def test_register(spark, tmp_path):
    a = write(tmp_path / "a.zst", b"{}\n")
    one = {"source_id": "x", "path": a, "source_kind": "comment", "declared_month": "2026-01"}
    reg = archive.register(spark, [one])
    assert archive.register(spark, [one, {**one, "source_id": "y"}], reg).count() == 2
    for bad in ([one, one], [{**one, "path": "/none"}], [{**one, "source_kind": "z"}]):
        with pytest.raises(ValueError):
            archive.register(spark, bad)
    with pytest.raises(ValueError, match="other facts"):
        archive.register(spark, [{**one, "declared_month": "2026-02"}], reg)


def test_strict_rows(spark):
    lines = lambda *x: spark.createDataFrame([(v,) for v in x], "raw_line string")
    kinds = {"a": "STRING", "n": "BIGINT", "d": "DOUBLE?"}
    assert archive.strict(lines('{"a":"x","n":1}', '{"a":"y","n":2,"d":3}'), kinds).orderBy("n").collect() == [("x", 1, None), ("y", 2, 3.0)]
    for bad in ('{"a":"x"}', '{"a":1,"n":1}', '{"a":"x","n":true}', '{"a":"x","n":1,"z":0}', "nope"):
        with pytest.raises(Exception, match="field"):
            archive.strict(lines(bad), kinds).collect()


def test_written_lines_come_back(spark, tmp_path):
    df = spark.createDataFrame([("b", 2, ["x"]), ("a", 1, None)], "k string, n long, l array<string>")
    digest = archive.write_lines(df, f"{tmp_path}/out.jsonl.zst", ["k"])
    data = zstandard.ZstdDecompressor().decompressobj().decompress((tmp_path / "out.jsonl.zst").read_bytes())
    assert data == b'{"k":"a","l":null,"n":1}\n{"k":"b","l":["x"],"n":2}\n' and digest == hashlib.sha256((tmp_path / "out.jsonl.zst").read_bytes()).hexdigest()


def test_publication(spark, tmp_path):
    df = spark.range(10)
    first = publish.publish(df, f"{tmp_path}/d", {"a": 1})
    assert first["rows"] == 10 and publish.published(spark, f"{tmp_path}/d").count() == 10
    assert publish.publish(df.limit(1), f"{tmp_path}/d", {"a": 1}) == first
    with pytest.raises(ValueError, match="another run"):
        publish.publish(df, f"{tmp_path}/d", {"a": 2})
    with pytest.raises(ValueError, match="complete"):
        publish.published(spark, f"{tmp_path}/none")
    with pytest.raises(ValueError, match="limit"):
        publish.check_budget(df, 10)


def test_config():
    assert archive.rules_of({"rules": [{"rule_id": "a", "required_term_groups": [["x"]]}]}) == {"a": [["x"]]}
    for bad in ([{"rule_id": "a", "required_term_groups": []}], [{"rule_id": "a", "required_term_groups": [["x"]]}] * 2, [{"rule_id": "a", "required_term_groups": [["x"]], "more": 1}]):
        with pytest.raises(ValueError):
            archive.rules_of({"rules": bad})
    with pytest.raises(ValueError):
        archive.scenarios_of({"scenarios": [{"scenario_id": "s", "lexical_queries": ["a"], "semantic_queries": ["b", "c"]}]})


def test_stream_reads_each_file_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    row = {"name": "t3_a", "title": "T", "subreddit": "r", "permalink": "/p", "created_utc": 1}
    for k in range(2):
        (folder / f"{k}.jsonl").write_text(json.dumps({**row, "name": f"t3_{k}"}) + "\n" + ("bad\n" if k else json.dumps({**row, "title": None}) + "\n"))
        ingest.ingest_available(spark, str(folder), "submission", f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert sorted(r["fullname"] for r in spark.read.parquet(f"{tmp_path}/out/messages").collect()) == ["t3_0", "t3_1"]
    assert spark.read.parquet(f"{tmp_path}/out/rejected").count() == 1


def archive_lines(rows):
    return sorted((r["source_id"], r["line_number"], r["raw_line"]) for r in rows.select("source_id", "line_number", "raw_line").collect())


@pytest.mark.parametrize("unit_bytes", [1, 7, 64, 1000, 1 << 20])
def test_units_give_every_line_once(spark, tmp_path, unit_bytes):
    """Plain and compressed files, cut anywhere: the lines and their numbers are those of a plain reading."""
    texts = {"a.jsonl": b"one\ntwo\n\nthree is longer\nx", "b.jsonl": b"\n\n\n", "c.jsonl": b"", "d.jsonl": b"only", "e.jsonl": "é\n".encode() * 9 + b"\xff\n"}
    paths, want = {}, []
    for name, data in texts.items():
        (tmp_path / name).write_bytes(data)
        paths[name] = str(tmp_path / name)
        cuts = [data[k : k + 5] for k in range(0, len(data), 5)]
        paths[name + ".zst"] = write(tmp_path / (name + ".zst"), *cuts) if cuts else write(tmp_path / (name + ".zst"), b"")
    reg = archive.register(spark, [{"source_id": n, "path": p, "source_kind": "comment"} for n, p in paths.items()])
    for name in paths:
        data = texts[name.removesuffix(".zst")]
        lines = data.split(b"\n")
        want += [(name, k, line.decode("utf-8", "replace")) for k, line in enumerate(lines[:-1] if not lines[-1] else lines, 1)]
    assert archive_lines(archive.scan(spark, reg, unit_bytes)) == sorted(want)


def test_one_large_file_is_read_by_many_tasks(spark, tmp_path):
    rows = [b'{"id":%d,"pad":"%s"}\n' % (k, b"x" * (k % 50)) for k in range(20_000)]
    path = write(tmp_path / "big.zst", *[b"".join(rows[k : k + 700]) for k in range(0, len(rows), 700)])
    lines = units.read_units(spark, [{"source_id": "s", "source_kind": "comment", "path": path}], 4000)
    parts = lines.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert lines.rdd.getNumPartitions() > 5 and len(parts) > 5 and max(r["count"] for r in parts) < 4000
    got = archive_lines(archive.scan(spark, sources(spark, path), 4000))
    assert [(n, json.loads(x)["id"]) for _, n, x in got] == [(k + 1, k) for k in range(20_000)]
    assert "monotonically_increasing_id" not in archive.scan(spark, sources(spark, path))._jdf.queryExecution().toString()
    listed = units.list_units(spark, [{"source_id": "s", "source_kind": "comment", "path": path}], 4000)
    assert listed.count() == len(units.ranges(path, 4000)) and units.lines_in(listed).count() == 20_000


def test_frames_of_all_kinds(tmp_path):
    pieces = [b"a" * 300_000, b"", b"xyz\n" * 50_000, bytes(range(256)) * 2000]
    packed = [zstandard.ZstdCompressor(write_checksum=k % 2 == 0, write_content_size=k > 1).compress(p) for k, p in enumerate(pieces)]
    skipped = b"\x50\x2a\x4d\x18\x05\x00\x00\x00hello"
    data = packed[0] + skipped + b"".join(packed[1:])
    (tmp_path / "f.zst").write_bytes(data)
    with open(tmp_path / "f.zst", "rb") as f:
        found = units.frames(f, len(data))
    assert [data[a:b] for a, b in found] == packed
    entries = b"".join(len(p).to_bytes(4, "little") + len(x).to_bytes(4, "little") for p, x in zip(packed, pieces, strict=True))
    table = b"\x5e\x2a\x4d\x18" + (len(entries) + 9).to_bytes(4, "little") + entries + len(packed).to_bytes(4, "little") + b"\x00" + units.SEEKABLE.to_bytes(4, "little")
    whole = b"".join(packed) + table
    (tmp_path / "g.zst").write_bytes(whole)
    with open(tmp_path / "g.zst", "rb") as f:
        assert [whole[a:b] for a, b in units.frames(f, len(whole))] == packed
    with open(tmp_path / "f.zst", "rb") as f, pytest.raises(ValueError, match="cut"):
        units.frames(f, len(packed[0]) - 3)


@pytest.mark.parametrize("compress", [True, False])
def test_shards_are_written_by_tasks(spark, tmp_path, compress):
    path = str(tmp_path / "shard.jsonl")
    df = spark.range(1000).select((F.lit(1000) - F.col("id")).alias("n"), F.concat(F.lit("é"), F.col("id").cast("string")).alias("text"), F.when(F.col("id") % 3 == 0, F.array("id")).alias("list")).repartition(7)
    digest = archive.write_lines(df, path, ["n"], compress)
    data = (tmp_path / "shard.jsonl").read_bytes()
    assert hashlib.sha256(data).hexdigest() == digest
    lines = (zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read() if compress else data).decode().splitlines()
    want = sorted((r.asDict() for r in df.collect()), key=lambda r: r["n"])
    assert lines == [publish.canonical_json(r).decode() for r in want]
    assert sorted(x.name for x in tmp_path.iterdir()) == ["shard.jsonl"]


def test_a_failed_write_leaves_the_old_shard(spark, tmp_path):
    path = str(tmp_path / "s.jsonl")
    archive.write_lines(spark.range(3), path, ["id"], False)
    bad = spark.range(10).select(F.when(F.col("id") == 7, F.raise_error(F.lit("no")).cast("long")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="no"):
        archive.write_lines(bad, path, ["id"], False)
    assert (tmp_path / "s.jsonl").read_text() == '{"id":0}\n{"id":1}\n{"id":2}\n'
    archive.write_lines(spark.range(0), path, ["id"], False)
    assert (tmp_path / "s.jsonl").read_text() == ""
