"""Published datasets: staged writes, a manifest as the mark of completion, and reuse of finished runs.

A dataset is written to a folder of its own and becomes visible when its manifest, written last, is there. A run with the
same identity finds the manifest and reuses the dataset. All paths go through Hadoop's file system interface.
"""

from __future__ import annotations

import hashlib
import json
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def canonical_json(value: object) -> bytes:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode()


def identity_hash(identity: dict) -> str:
    return hashlib.sha256(canonical_json(identity)).hexdigest()


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir's folder. Only where all run on one machine, and none is set, a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lodestar-"))
    return sc.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: the lineage ends there."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df dealt to all cores where it comes from fewer files than there are cores; tables of many files stay where they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def read_manifest(spark: SparkSession, folder: str) -> dict | None:
    fs, p = _fs(spark, f"{folder}/manifest.json")
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def publish(df: DataFrame, folder: str, identity: dict, extra: dict | None = None) -> dict:
    """Writes df and its manifest; a finished run of the same identity is returned as it is, another one is an error."""
    spark = df.sparkSession
    run_id = identity_hash(identity)
    found = read_manifest(spark, folder)
    if found:
        if found["run_id"] != run_id:
            raise ValueError(f"{folder} holds another run")
        return found
    fs, target = _fs(spark, f"{folder}/data")
    staging = _fs(spark, f"{folder}/_staging-{run_id}")[1]
    df.write.mode("overwrite").parquet(staging.toString())
    if fs.exists(target):  # of a run that ended before its manifest
        fs.delete(target, True)
    if not fs.rename(staging, target):
        raise OSError(f"can't publish {folder}")
    manifest = {"run_id": run_id, "identity": identity, "rows": spark.read.parquet(target.toString()).count(), **(extra or {})}
    part = _fs(spark, f"{folder}/_manifest-{run_id}.json")[1]
    out = fs.create(part, True)
    out.write(canonical_json(manifest))
    out.close()
    if not fs.rename(part, _fs(spark, f"{folder}/manifest.json")[1]):
        raise OSError(f"can't publish {folder}")
    return manifest


def overwritten(df: DataFrame, path: str) -> DataFrame:
    """df as a Parquet table at path, in the place of what is there, read back."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def listed(spark: SparkSession, folder: str, prefix: str) -> list[int]:
    """The numbers of the folders prefix<number> within a folder, in order."""
    fs, p = _fs(spark, folder)
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n.removeprefix(prefix)) for n in names if re.fullmatch(re.escape(prefix) + r"\d+", n))


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def published(spark: SparkSession, folder: str) -> DataFrame:
    if read_manifest(spark, folder) is None:
        raise ValueError(f"{folder} isn't complete")
    return spark.read.parquet(f"{folder}/data")


def fingerprint(df: DataFrame) -> str:
    """A digest of the rows' content, whatever their order or files: count and two sums of row hashes."""
    from pyspark.sql import functions as F

    texts = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    sums = [F.sum(F.xxhash64(texts, F.lit(salt)).cast("decimal(38,0)")) for salt in (1, 2)]
    return hashlib.sha256(canonical_json([str(x) for x in df.agg(F.count("*"), *sums).first()])).hexdigest()


class Conflict(ValueError):
    """Another writer came first."""


def _entry(root: str, number: int) -> str:
    return f"{root}/_log/{number:010d}.json"


def commit(spark: SparkSession, root: str, value: dict, after: int) -> int:
    """Adds entry after + 1 to the numbered log of root; of writers that add the same number exactly one succeeds, the others get Conflict.

    The entry is written beside the log and gets its name, whole, in one step that fails where the name is taken: a hard link on
    local disks, a rename without overwriting elsewhere. Readers see an entry whole or not at all, and the log is never without its last one.
    """
    number, jvm = after + 1, spark.sparkContext._jvm
    fs, target = _fs(spark, _entry(root, number))
    part = _fs(spark, f"{root}/_log/_{uuid.uuid4().hex}.json")[1]
    out = fs.create(part, True)
    out.write(canonical_json(value))
    out.close()
    try:
        if fs.getScheme() == "file":
            local = [jvm.java.nio.file.Paths.get(p.toUri().getPath(), spark.sparkContext._gateway.new_array(jvm.String, 0)) for p in (target, part)]
            jvm.java.nio.file.Files.createLink(*local)
        else:
            none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
            none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(part, target, none)
    except Exception as error:
        if "AlreadyExists" not in str(error):
            raise
        raise Conflict(f"entry {number} of {root} was written by another") from None
    finally:
        fs.delete(part, False)
    return number


def head(spark: SparkSession, root: str) -> tuple[int, dict | None]:
    """(number, value) of the last entry of root's log; (0, None) where there is none."""
    fs, p = _fs(spark, f"{root}/_log")
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    number = max((int(n[:10]) for n in names if re.fullmatch(r"\d{10}\.json", n)), default=0)
    if not number:
        return 0, None
    stream = fs.open(_fs(spark, _entry(root, number))[1])
    try:
        return number, json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def current(spark: SparkSession, root: str) -> str | None:
    """The folder of the generation that is in force under root."""
    found = head(spark, root)[1]
    return found and found["folder"]


def switch(spark: SparkSession, root: str, folder: str, after: int | None = None) -> dict:
    """Puts a complete generation in force; the one before is kept as previous. after: the log entry that the caller has seen; Conflict if there is a later one."""
    if read_manifest(spark, folder) is None:
        raise ValueError(f"{folder} isn't complete")
    number, before = head(spark, root)
    if after is not None and after != number:
        raise Conflict(f"{root} is at entry {number}, not {after}")
    now = {"folder": folder, "previous": before and before["folder"]}
    commit(spark, root, now, number)
    return now


def rollback(spark: SparkSession, root: str) -> str:
    """Puts the previous generation in force again; an error if there is none."""
    number, found = head(spark, root)
    if not found or not found["previous"]:
        raise ValueError("there is no generation to go back to")
    return switch(spark, root, found["previous"], number)["folder"]


def ordered_digest(df: DataFrame, order: list[str], arity: int = 4096) -> str:
    """A digest of rows in an order that leaves no ties, for tables of any size: the same however they are partitioned.

    Rows are numbered by running totals over ranges; the digests of `arity` neighbours at a time are hashed together, level by
    level, so that no task holds more than that many digests. An empty table has the digest of the empty text.
    """
    from pyspark.sql import functions as F

    from ..operators.ordering import numbered

    line = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    level = written(numbered(df.select(*order, line.alias("digest")), order, "place").select((F.col("place") - 1).alias("place"), "digest"))
    n = level.count()
    while n > 1:
        runs = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "digest"))), lambda x: x["digest"]), "")
        level, n = written(level.groupBy(F.floor(F.col("place") / arity).alias("place")).agg(F.sha2(runs, 256).alias("digest"))), -(-n // arity)
    found = level.first()
    return found["digest"] if found else hashlib.sha256(b"").hexdigest()


def bucketed(df: DataFrame, folder: str, identity: dict, key: str, buckets: int = 64) -> DataFrame:
    """Publishes df in buckets of a key, sorted within; joins on the key then move the other side only. A finished run of the same identity is reused."""
    spark = df.sparkSession
    name = f"lodestar_{hashlib.sha256(folder.encode()).hexdigest()[:24]}"
    found = read_manifest(spark, folder)
    if found and found["run_id"] != identity_hash(identity):
        raise ValueError(f"{folder} holds another run")
    if not found:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        delete(spark, f"{folder}/table")
        df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", f"{folder}/table").format("parquet").saveAsTable(name)
        fs, part = _fs(spark, f"{folder}/_manifest.json")
        out = fs.create(part, True)
        out.write(canonical_json({"run_id": identity_hash(identity), "identity": identity, "rows": spark.table(name).count(), "key": key, "buckets": buckets, "schema": df.schema.json()}))
        out.close()
        if not fs.rename(part, _fs(spark, f"{folder}/manifest.json")[1]):
            raise OSError(f"can't publish {folder}")
    return open_bucketed(spark, folder)


def open_bucketed(spark: SparkSession, folder: str) -> DataFrame:
    """A table that bucketed() published; a session that doesn't know it is told its buckets."""
    from pyspark.sql.types import StructType

    facts = read_manifest(spark, folder)
    if facts is None or "buckets" not in facts:
        raise ValueError(f"{folder} isn't a complete table in buckets")
    name = f"lodestar_{hashlib.sha256(folder.encode()).hexdigest()[:24]}"
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in StructType.fromJson(json.loads(facts["schema"])).fields)
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{facts['key']}`) SORTED BY (`{facts['key']}`) INTO {facts['buckets']} BUCKETS LOCATION '{folder}/table'")
    return spark.table(name)


def check_budget(df: DataFrame, limit_bytes: int, bytes_of=None) -> int:
    """The size of df as JSON lines; an error beyond the limit."""
    from ..functions.text import json_bytes

    size = df.agg((bytes_of if bytes_of is not None else json_bytes(*df.columns)).alias("n")).first()["n"] or 0
    if size > limit_bytes:
        raise ValueError(f"{size} bytes to stage; the limit is {limit_bytes}")
    return size
