"""Archives of JSON lines, plain or zstandard: scans with line numbers, quarantine, checksums, registers, and sinks."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.publish import written
from ..schemas import SOURCE
from .sinks import write_shard
from .units import MAX_LINE, located, read_units

#: Bytes of a file that are read at a time for its digest.
BLOCK = 8 << 20


def scan(spark: SparkSession, sources: DataFrame, unit_bytes: int | None = None) -> DataFrame:
    """(source_id, source_kind, line_number, raw_line) of registered sources (their number is that of files).

    Line numbers are physical, from 1, and count bad rows too. Many tasks read a file, by byte ranges or zstandard frames; each
    numbers its lines, and the lines of a file's earlier units are added: a row for each unit, from a first pass. Plans that write the lines anyway take read_units and `numbered` and read once.
    """
    known = [r.asDict() for r in sources.collect()]
    if not known:
        return spark.createDataFrame([], "source_id string, source_kind string, line_number bigint, raw_line string")
    lines = read_units(spark, known, unit_bytes)
    told = numbered(lines, written(unit_counts(lines)))
    return told.select("source_id", "source_kind", "line_number", F.col("value").cast("string").alias("raw_line"))


def first_lines(spark: SparkSession, sources: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """The first `most` lines by source and line number, as rows of units.SCHEMA, and whether there are more. Nothing is sorted: a line's place follows from the lines of earlier units."""
    lines = read_units(spark, [r.asDict() for r in sources.collect()])
    counts = written(unit_counts(lines))
    earlier = F.sum("lines").over(Window.orderBy("source_id", "unit")) - F.col("lines")  # a row for each unit
    kept = lines.join(counts.select("source_id", "unit", earlier.alias("__before")), ["source_id", "unit"]).where(F.col("__before") + F.col("place") < most).drop("__before")
    return kept, (counts.agg(F.sum("lines")).first()[0] or 0) > most


def unit_counts(lines: DataFrame) -> DataFrame:
    """(source_id, unit, lines) of rows (source_id, unit, ...): the lines of each unit."""
    return lines.groupBy("source_id", "unit").agg(F.count("*").alias("lines"))


def numbered(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """rows (source_id, unit, place, ...) with line_number, by the lines of each unit (source_id, unit, lines)."""
    earlier = F.sum("lines").over(Window.partitionBy("source_id").orderBy("unit")) - F.col("lines")
    before = counts.select("source_id", "unit", earlier.alias("__before"))
    return rows.join(before, ["source_id", "unit"]).withColumn("line_number", F.col("__before") + F.col("place") + 1).drop("__before")


def line_problem(raw: Column, max_bytes: int = MAX_LINE) -> Column:
    """too_long, invalid_json, not_an_object or null. NaN and doubled keys aren't JSON here, which is stricter than some parsers."""
    v = F.try_parse_json(raw)
    return F.when(F.octet_length(raw) + 1 > max_bytes, "too_long").when(v.isNull(), "invalid_json").when(~F.schema_of_variant(v).startswith("OBJECT"), "not_an_object")


def quarantined(lines: DataFrame, max_bytes: int = MAX_LINE) -> DataFrame:
    """lines with a column problem; rows without one are good."""
    return lines.withColumn("problem", line_problem(F.col("raw_line"), max_bytes))


def reader_stats(marked: DataFrame) -> DataFrame:
    """(source_id, lines_seen, valid, invalid, invalid_line_numbers, bytes, complete)."""
    bad = F.col("problem").isNotNull()
    return marked.groupBy("source_id").agg(
        F.count("*").alias("lines_seen"), F.count_if(~bad).alias("valid"), F.count_if(bad).alias("invalid"), F.sort_array(F.collect_list(F.when(bad, F.col("line_number")))).alias("invalid_line_numbers"),
        F.sum(F.octet_length("raw_line") + 1).alias("bytes"), (F.count_if(bad) == 0).alias("complete"),
    )


def checksum(spark: SparkSession, path: str) -> str:
    """SHA-256 of a file's bytes."""
    return checksums(spark, [path])[path]


def checksums(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """SHA-256 of files, a task for each; no more than a block of a file is held at a time."""
    if not paths:
        return {}

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, name = located(path)
                digest = hashlib.sha256()
                with system.open_input_stream(name, compression=None) as f:
                    while data := f.read(BLOCK):
                        digest.update(data)
                yield pa.RecordBatch.from_pydict({"path": pa.array([path]), "digest": pa.array([digest.hexdigest()])})

    named = spark.createDataFrame([(p,) for p in sorted(set(paths))], "path string")
    found = named.repartition(max(1, min(len(set(paths)), 10_000)), "path").mapInArrow(digests, "path string, digest string")
    return {r["path"]: r["digest"] for r in found.collect()}  # a row for each file


def facts(spark: SparkSession, sources: DataFrame) -> list[dict]:
    """What names the content of sources: their rows with the checksum of the file, or the declared one together with the file's size and time."""
    rows = [r.asDict() for r in sources.orderBy("source_id").collect()]  # one row for each file
    real = checksums(spark, [r["path"] for r in rows if not r.get("expected_checksum")])
    for r in rows:
        r["checksum"] = real.get(r["path"])
        if r["checksum"] is None:
            system, name = located(r["path"])
            info = system.get_file_info(name)
            r |= {"bytes": info.size, "modified": info.mtime_ns}
        r.pop("status", None)
    return rows


def register(spark: SparkSession, declarations: list[dict], existing: DataFrame | None = None) -> DataFrame:
    """The register of sources: ids must differ and paths must exist; sources known already stay as they are, and one with another path, month, checksum or scope is an error."""
    ids = [d["source_id"] for d in declarations]
    if len(set(ids)) < len(ids):
        raise ValueError("source ids stand twice")
    names = [f.split()[0] for f in SOURCE.split(", ")]
    for d in declarations:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(d["path"])
        if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            raise ValueError(f"no such source: {d['path']}")
        if d["source_kind"] not in ("submission", "comment") or d.get("source_role", "discovery") not in ("discovery", "context_only"):
            raise ValueError(f"unknown kind or role of {d['source_id']}")
    new = spark.createDataFrame([tuple(d.get(n, {"source_role": "discovery", "status": "registered"}.get(n)) for n in names) for d in declarations], SOURCE)
    if existing is None:
        return new
    fixed = ("path", "declared_month", "expected_checksum", "usage_scope")
    clash = new.alias("a").join(existing.alias("b"), "source_id").where(" OR ".join(f"NOT a.{c} <=> b.{c}" for c in fixed))
    if found := [r[0] for r in clash.select("source_id").limit(5).collect()]:
        raise ValueError(f"sources registered with other facts: {found}")
    return existing.unionByName(new.join(existing, "source_id", "left_anti"))


def validate(spark: SparkSession, sources: DataFrame) -> DataFrame:
    """Register rows with their status after a full read: complete, complete_with_errors or failed (unreadable, or another checksum)."""
    listed = sources.collect()  # one row for each file
    try:  # all at once
        digests = checksums(spark, [r["path"] for r in listed])
        stats = {r["source_id"]: r for r in reader_stats(quarantined(scan(spark, sources))).collect()}
        rows = [_verdict(r, digests[r["path"]], stats.get(r["source_id"])) for r in listed]
    except Exception:  # one that can't be read fails them all: now each by itself
        rows = []
        for r in listed:
            try:
                rows.append(_verdict(r, checksum(spark, r["path"]), reader_stats(quarantined(scan(spark, sources.where(F.col("source_id") == r["source_id"])))).first()))
            except Exception as error:  # an unreadable source is a result, not a fault of the run
                rows.append((r["source_id"], "failed", str(error)[:200], 0, 0))
    return spark.createDataFrame(rows, "source_id string, status string, detail string, lines_seen bigint, invalid bigint")


def _verdict(source, digest: str, stats) -> tuple:
    """The row of validate() for a source with its digest and its row of reader_stats, or none if it has no lines."""
    invalid = stats["invalid"] if stats else 0
    status = "failed" if source["expected_checksum"] not in (None, digest) else "complete_with_errors" if invalid else "complete"
    return source["source_id"], status, digest, stats["lines_seen"] if stats else 0, invalid


def strict(lines: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Columns of JSON lines (raw_line) by declared type; any row with a missing, mistyped or undeclared field is an error.

    kinds: field -> STRING, BIGINT, DOUBLE or BOOLEAN, with a question mark where null is allowed.
    """
    types = {"STRING": "string", "BIGINT": "bigint", "DOUBLE": "double", "BOOLEAN": "boolean"}
    v = F.try_parse_json("raw_line")
    more = F.coalesce(F.size(F.array_except(F.json_object_keys("raw_line"), F.array(*map(F.lit, kinds)))) > 0, F.lit(True))
    out = []
    for name, declared in kinds.items():
        kind = declared.rstrip("?")
        seen = F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant")), F.lit("VOID"))
        fits = seen.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)") if kind == "DOUBLE" else seen == kind
        if declared.endswith("?"):
            fits = fits | (seen == "VOID")
        wrong = F.raise_error(F.concat(F.lit(f"field {name} or one that isn't declared: "), F.substring("raw_line", 1, 200))).cast(types[kind])
        out.append(F.when(~more & fits, F.try_variant_get(v, f"$.{name}", types[kind])).otherwise(wrong).alias(name))
    return lines.select(*out)


def read_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of a declared schema; blank lines are skipped and a row that isn't an object of it is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_lines(df: DataFrame, path: str, order: list[str], compress: bool = True) -> str:
    """One file of JSON lines with sorted keys, zstandard if asked, in the given order; for hand-over of bounded shards. Returns its SHA-256.

    Tasks write a frame for each range of the order, the commit lists those that count, and one task joins them (sinks); no row
    passes through the driver. The file appears under its name when it is whole.
    """
    return write_shard(df.orderBy(*order), path, compress)


def load_config(path: str) -> dict:
    """A configuration from YAML (if that library is at hand) or JSON."""
    with open(path, encoding="utf-8") as f:
        if PurePosixPath(path).suffix in (".yaml", ".yml"):
            try:
                import yaml
            except ImportError as error:
                raise RuntimeError("reading YAML needs the yaml library; JSON needs none") from error
            return yaml.safe_load(f)
        return json.load(f)


def rules_of(config: dict) -> dict[str, list[list[str]]]:
    """Discovery rules of a configuration; ids must differ and no group may be empty."""
    rules: dict[str, list[list[str]]] = {}
    for r in config["rules"]:
        if set(r) - {"rule_id", "required_term_groups"}:
            raise ValueError(f"unknown fields in rule {r.get('rule_id')}")
        if r["rule_id"] in rules or not r["required_term_groups"] or not all(r["required_term_groups"]):
            raise ValueError(f"bad rule {r['rule_id']}")
        rules[r["rule_id"]] = [list(g) for g in r["required_term_groups"]]
    return rules


def scenarios_of(config: dict) -> list[dict]:
    """Scenarios of a configuration: three to five lexical and two to three semantic queries, ids that differ."""
    seen: set[str] = set()
    for s in config["scenarios"]:
        if s["scenario_id"] in seen or not 3 <= len(s["lexical_queries"]) <= 5 or not 2 <= len(s["semantic_queries"]) <= 3:
            raise ValueError(f"bad scenario {s['scenario_id']}")
        seen.add(s["scenario_id"])
    return list(config["scenarios"])

