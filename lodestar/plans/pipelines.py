"""The engine's plans: from archives to a review worksheet, from messages to an index, from branches to compared runs, and deletion."""

from __future__ import annotations

import platform
import shutil
import time
from collections.abc import Callable
from dataclasses import dataclass, field

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import casefold, stable_rank
from ..operators import audit, context, fusion, lexical, messages, review, state, tombstones, units
from ..sources import archive
from ..streaming import bounded
from . import publish


#: A unit and a place within it as one number, in the place of a line number until those are known.
_PLACES = 1 << 40


def _classified(lines: DataFrame, classes: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(source_id, unit, place, class, m) of archive lines: quarantined, rejected, or what `classes` (messages -> messages with class) says; m is the message."""
    bad = archive.line_problem(F.col("raw_line")).isNotNull()
    code = F.col("unit").cast("bigint") * _PLACES + F.col("place")
    told = lines.select("source_id", "source_kind", F.when(bad, -code - 1).otherwise(code).alias("line_number"), F.when(~bad, F.col("raw_line")).alias("raw_line"))
    read = classes(messages.normalize(told))
    at = F.col("provenance")[0]["line_number"]
    place = F.when(at < 0, -at - 1).otherwise(at)
    kind = F.when(at < 0, "quarantined").when(F.col("norm_error").isNotNull(), "rejected").otherwise(F.col("class"))
    own = [c for c in read.columns if c not in ("norm_error", "class", "provenance")]
    return read.select(F.col("provenance")[0]["source_id"].alias("source_id"), F.floor(place / _PLACES).cast("int").alias("unit"), (place % _PLACES).alias("place"), kind.alias("class"), F.struct(*own).alias("m"))


def _messages(state: DataFrame) -> DataFrame:
    """The messages of a scan's state, with their provenance."""
    return state.select("m.*", F.array(F.struct("source_id", "line_number")).alias("provenance"))


def _found(alive: DataFrame, rules: dict[str, list[list[str]]]) -> DataFrame:
    """Messages with the rules that they match and, where any does, the channel."""
    ids = messages.matched_rules(casefold(F.concat_ws("\n", "raw_title", "raw_body")), rules)
    told = alive.withColumn("matched_rule_ids", ids)
    return told.withColumn("selection_channels", F.when(F.size("matched_rule_ids") > 0, F.array(F.lit(messages.CHANNEL))).otherwise(F.col("selection_channels")))


def discovery(spark: SparkSession, sources: DataFrame, rules: dict[str, list[list[str]]], target: int, seed: int, out: str, ledger: DataFrame | None = None, max_records: int | None = None, queue_limit: int = 100, **scan) -> dict:
    """Reads sources, quarantines, normalises, drops tombstoned messages, matches rules, samples, and publishes selection, cards, queue and worksheet.

    The archive is read once, and a run that was stopped goes on where it was (streaming.bounded; `scan` is passed to it). With
    max_records only so many first lines (by source and line number) are read, and the manifest says scan_complete = false. The
    same identity, which holds what the files contain, finds the finished datasets. Counts of every step are in the manifest;
    matched counts messages, before repeated names are left out.
    """
    digest = tombstones.ledger_digest(ledger).first()["digest"] if ledger is not None else None
    identity = {"sources": archive.facts(spark, sources), "rules": rules, "target": target, "seed": seed, "max_records": max_records, "ledger": digest}
    run_id = publish.identity_hash(identity)
    if done := publish.read_manifest(spark, f"{out}/selection"):
        if done["run_id"] != run_id:
            raise ValueError(f"{out} holds another run")
        return done
    gone = ledger.select("message_fullname", "source_revision_id") if ledger is not None else spark.createDataFrame([], "message_fullname string, source_revision_id string")

    def classes(normal: DataFrame) -> DataFrame:
        told = _found(context.with_tombstoned(normal, gone, "__gone"), rules)
        return told.withColumn("class", F.when(F.col("__gone"), "tombstoned").when(F.size("matched_rule_ids") > 0, "matched").otherwise("other")).drop("__gone")

    kept = {"matched": bounded.Kept(target, seed)}
    if max_records is None:
        result = bounded.bounded_scan(spark, sources, lambda lines: _classified(lines, classes), kept, f"{out}/scan-{run_id[:16]}", **scan)
        by_class = {r["class"]: r["n"] for r in result.counts.groupBy("class").agg(F.sum("n").alias("n")).collect()}
        selected, capped = publish.written(_messages(result.state)), False
    else:
        lines, capped = archive.first_lines(spark, sources, max_records)
        told = publish.written(_classified(lines.withColumn("raw_line", F.col("value").cast("string")), classes))
        by_class = {r["class"]: r["n"] for r in told.groupBy("class").agg(F.count("*").alias("n")).collect()}
        best = bounded.least(told.where("class = 'matched'").withColumn("rank", stable_rank(seed, F.col("m.fullname"))), kept)
        selected = publish.written(_messages(archive.numbered(best, publish.written(archive.unit_counts(lines)))))
    counts = {"lines": sum(by_class.values()), **{c: by_class.get(c, 0) for c in ("quarantined", "rejected", "tombstoned", "matched")}, **messages.thread_freeze(selected).first().asDict()}
    cards = publish.written(review.cards(selected, F.col("created_utc") * 0 + F.xxhash64(F.lit(seed), "fullname")))
    publish.publish(cards, f"{out}/cards", identity)
    if counts["selected"]:
        queue = publish.written(review.balanced_queue(cards, queue_limit))
        publish.publish(queue, f"{out}/queue", identity)
        publish.publish(review.worksheet(queue), f"{out}/worksheet", identity)
    return publish.publish(selected, f"{out}/selection", identity, {"scan_complete": not capped, "counts": counts})


def hydration(spark: SparkSession, sources: DataFrame, selection: DataFrame, context_target: int, control_target: int, seed: int, out: str, ledger: DataFrame | None = None, max_records: int | None = None, **scan) -> dict:
    """Publishes the selection's context (least digests of `seed` among messages of its threads) and controls (of seed + 1, other messages), and a report.

    The archive is read once; a run that was stopped goes on where it was and ends with the rows of one undisturbed run. Of
    messages that repeat a name the first by source and line counts. A scan that meets more than max_records lines, without
    quarantined ones, withholds both shards: nothing is published, and the report says complete = false.
    """
    digest = tombstones.ledger_digest(ledger).first()["digest"] if ledger is not None else None
    chosen = publish.written(selection.select("fullname", "thread_fullname").distinct())
    identity = {"sources": archive.facts(spark, sources), "selection": publish.fingerprint(selection), "context": context_target, "controls": control_target, "seed": seed, "max_records": max_records, "ledger": digest}
    run_id = publish.identity_hash(identity)
    if done := publish.read_manifest(spark, f"{out}/context"):
        if done["run_id"] != run_id:
            raise ValueError(f"{out} holds another run")
        return done
    gone = ledger.select("message_fullname", "source_revision_id") if ledger is not None else spark.createDataFrame([], "message_fullname string, source_revision_id string")
    kept = {"context": bounded.Kept(context_target, seed), "control": bounded.Kept(control_target, seed + 1)}
    result = bounded.bounded_scan(spark, sources, lambda lines: _classified(lines, lambda normal: context.hydration_classes(normal, chosen, gone)), kept, f"{out}/scan-{run_id[:16]}", max_records=max_records, **scan)
    report: dict[str, dict[str, int]] = {}
    for r in result.counts.orderBy("source_id", "class").collect():  # at most six rows for each file
        report.setdefault(r["source_id"], {})[r["class"]] = r["n"]
    roles = {r["source_id"]: r["source_role"] for r in sources.collect()}
    facts = {"complete": result.complete, "sources": report, "context_from_context_only": sum(c.get("context", 0) for s, c in report.items() if roles[s] == "context_only")}
    if not result.complete:
        return {"run_id": run_id, "withheld": ["context", "controls"], **facts}
    rows = publish.written(result.state)
    publish.publish(_messages(rows.where("class = 'control'")), f"{out}/controls", identity)
    return publish.publish(_messages(rows.where("class = 'context'")), f"{out}/context", identity, facts)


def build_corpus(selected: DataFrame, hydrated: DataFrame, snapshot_id: str, out: str, ledger: DataFrame | None = None, max_bytes: int = 10 << 30, max_words: int = units.MAX_WORDS, overlap: int = units.OVERLAP, chunking_version: str = "v2", recipe_version: str = "v1") -> dict:
    """Publishes units and postings of a snapshot: selected messages, with the hydrated ones as their context; a budget is checked on an estimate first.

    The identity of the run is that of all its inputs: rows of both tables, ledger, snapshot, sizes and versions. A selection without rows, or with a name twice, is an error.
    """
    spark = selected.sparkSession
    digest = tombstones.ledger_digest(ledger).first()["digest"] if ledger is not None else None
    identity = {"selected": publish.fingerprint(selected), "hydrated": publish.fingerprint(hydrated), "ledger": digest, "snapshot": snapshot_id, "max_bytes": max_bytes, "max_words": max_words, "overlap": overlap, "chunking": chunking_version, "recipe": recipe_version}
    for name in ("units", "postings"):
        if (done := publish.read_manifest(spark, f"{out}/{name}")) and done["run_id"] != publish.identity_hash(identity):
            raise ValueError(f"{out} holds another run")
    if done and (built := publish.read_manifest(spark, f"{out}/units")):
        return built
    rows, names = selected.agg(F.count("*"), F.countDistinct("fullname")).first()
    if not rows or rows > names:
        raise ValueError("the selection is empty" if not rows else "the selection holds a name twice")
    living = (lambda x: tombstones.without_tombstoned(x, ledger)) if ledger is not None else (lambda x: x)
    chosen = living(selected)
    alive = publish.written(context.merged_messages(chosen, living(hydrated)))
    focus = alive.join(chosen.select("fullname"), "fullname", "left_semi")
    estimate = focus.agg(F.sum(units.chunk_count(F.concat_ws("\n", "raw_title", "raw_body"), max_words, overlap))).first()[0] or 0
    if estimate * 8192 > max_bytes:
        raise ValueError(f"about {estimate} units are more than the budget of {max_bytes} bytes")
    made = units.search_units(focus, context.ancestor_chains(alive, focus), snapshot_id, chunking_version, recipe_version, max_words, overlap, context_from=alive)
    manifest = publish.publish(made, f"{out}/units", identity)
    stored = publish.published(spark, f"{out}/units")
    n, mean = lexical.statistics(stored)
    publish.publish(lexical.postings(stored, ("snapshot_id", "unit_id")).repartitionByRange("term"), f"{out}/postings", identity, {"units": n, "mean_length": mean})
    return manifest


def lexical_scenarios(spark: SparkSession, corpus: str, scenarios: list[dict], per_query: int = 100, limit: int = 100) -> DataFrame:
    """Ranked rows of each scenario's lexical queries over a published corpus, merged by best score; the postings are grouped once for all of them."""
    post, facts = publish.published(spark, f"{corpus}/postings"), publish.read_manifest(spark, f"{corpus}/postings")
    stated = [(s["scenario_id"], k, text) for s in scenarios for k, text in enumerate(s["lexical_queries"])]
    hits = lexical.search(post, stated, facts["units"], facts["mean_length"], per_query, id_cols=("snapshot_id", "unit_id"))
    return lexical.scenario_merge(hits.drop("snapshot_id"), limit)


@dataclass
class Variant:
    """A compared pipeline: which branches it fuses, whether it reranks, and whether it makes a feedback pass."""

    name: str
    branches: tuple[str, ...]
    rerank: bool = False
    feedback: bool = False


#: The compared variants.
VARIANTS = (Variant("A", ("lexical",)), Variant("B", ("dense", "lexical"), rerank=True), Variant("C", ("dense", "lexical"), rerank=True, feedback=True))


def candidates(branches: DataFrame, blocked: DataFrame | None = None, limit: int = 100, k: float = 60.0, weights: dict[str, float] | None = None) -> DataFrame:
    """The fused candidates of one scenario; blocked ones (candidate_id) are left out before and after fusion. The lexical branch must be there."""
    if branches.where("branch = 'lexical'").isEmpty():
        raise ValueError("candidate generation needs the lexical branch")
    keep = (lambda x: x.join(blocked.select("candidate_id").distinct(), "candidate_id", "left_anti")) if blocked is not None else (lambda x: x)
    return keep(fusion.rrf(keep(branches), k, weights, limit))


def compare(branches: DataFrame, score, feedback: Callable[[DataFrame], DataFrame] | None = None, split: str = "dev", allow_test: bool = False, output: int = 20, depth: int = 100, variants: tuple[Variant, ...] = VARIANTS) -> tuple[DataFrame, dict]:
    """(variant, candidate_id, rank) of each variant and the seconds that each took to plan and run. The test split needs allow_test."""
    if split not in ("dev", "test") or (split == "test" and not allow_test):
        raise ValueError("the test split is compared only when that is asked for")
    runs, cost = None, {}
    for v in variants:
        began = time.perf_counter()
        mine = branches.where(F.col("branch").isin(*v.branches))
        ranked = candidates(mine, limit=depth) if len(v.branches) > 1 else fusion.variant_merge(mine.withColumn("variant", F.lit(0)), depth)
        if v.rerank:
            ranked = fusion.rerank(ranked, score, depth).withColumn("rank", F.col("rerank_rank"))
        if v.feedback and feedback is not None:
            union = fusion.feedback_union(ranked, feedback(ranked), 2 * depth)
            ranked = fusion.rerank(union, score, 2 * depth).withColumn("rank", F.col("rerank_rank"))
        one = publish.written(ranked.where(F.col("rank") <= output).select(F.lit(v.name).alias("variant"), "candidate_id", "rank"))
        runs = one if runs is None else runs.unionByName(one)
        cost[v.name] = round(time.perf_counter() - began, 3)
    return runs, cost


def union_runs(runs: DataFrame) -> DataFrame:
    """Runs of several variants under the name variant__scenario."""
    return runs.withColumn("run", F.concat_ws("__", "variant", "scenario_id"))


def exposure_audit(archive_records: DataFrame, corpus_units: DataFrame, exposures: DataFrame, out: str, partitioned: bool = False) -> dict:
    """Publishes matches, coverage and collisions of an archive (source_id, line, four fields). The partitioned form keeps only records that an exposure could match."""
    identity = {"partitioned": partitioned, "archive": publish.fingerprint(archive_records), "exposures": publish.fingerprint(exposures), "corpus": publish.fingerprint(corpus_units)}
    if (done := publish.read_manifest(archive_records.sparkSession, f"{out}/matches")) and done["run_id"] != publish.identity_hash(identity):
        raise ValueError(f"{out} holds another run")
    resolved = publish.written(audit.resolve_exposures(exposures, corpus_units))
    seen = publish.written(audit.targeted(archive_records, resolved) if partitioned else archive_records)
    manifest = publish.publish(audit.match_exposures(resolved, seen), f"{out}/matches", identity)
    publish.publish(audit.coverage(seen, corpus_units.select(*audit.KEYS)), f"{out}/coverage", identity)
    publish.publish(audit.collisions(seen, corpus_units.select(*audit.KEYS), archive_only=partitioned), f"{out}/collisions", identity)
    return manifest


def delete(spark: SparkSession, corpus: str, ledger: DataFrame, snapshot_id: str, out: str) -> dict:
    """Publishes a new generation of a corpus's units without what the ledger removes; the old one stays. Nothing is published if nothing changes."""
    old = publish.published(spark, f"{corpus}/units")
    if bad := tombstones.checked_ledger(ledger).where("problem IS NOT NULL").select("problem").distinct().collect():
        raise ValueError(f"the ledger has {[r[0] for r in bad]}")
    after, counts = tombstones.apply_tombstones(old, ledger, snapshot_id)
    told = counts.first().asDict()
    if not told["matched"]:
        return {"published": False, "counts": told}
    identity = {"corpus": publish.read_manifest(spark, f"{corpus}/units")["run_id"], "ledger": tombstones.ledger_digest(ledger).first()["digest"]}
    manifest = publish.publish(after, f"{out}/units", identity, {"counts": told})
    if manifest["rows"] != old.count() - told["deleted"]:
        raise ValueError("the new generation doesn't have the rows that it should")
    return {"published": True, **manifest}


def operate(spark: SparkSession, outbox: DataFrame, corpus: str, ledger: DataFrame, snapshot_id: str, out: str, now: str, limit: int = 1000) -> tuple[DataFrame, dict]:
    """One round over the outbox: claim, delete, and record what came of it; a failed deletion is recorded as such and can be replayed."""
    claimed = publish.written(state.claim(outbox, limit, now))
    mine = claimed.where("status = 'in_progress'").select("identity")
    try:
        result = delete(spark, corpus, ledger, snapshot_id, out)
        seen = result["counts"]
        outcome = mine.select("identity", F.lit(seen["matched"]).cast("bigint").alias("observed"), F.lit(seen["deleted"]).cast("bigint").alias("deleted"), F.lit(None).cast("string").alias("error"))
    except ValueError as error:
        result = {"published": False, "error": str(error)}
        outcome = mine.select("identity", F.lit(None).cast("bigint").alias("observed"), F.lit(None).cast("bigint").alias("deleted"), F.lit(str(error)).alias("error"))
    return state.complete(claimed, outcome, now), result


def purge(spark: SparkSession, root: str, ledger: DataFrame, snapshot_id: str, backup: str) -> dict:
    """Deletes what a ledger names from the generation of units in force under root, after a verified backup.

    Where nothing is left to delete, nothing is written. Otherwise the generation is copied to `backup` and read back, the
    deletion is staged as a new generation, and that one is put in force only if its content differs; if anything fails, the
    old one stays in force. The old generation stays as the previous one, for publish.rollback.
    """
    seen, pointer = publish.head(spark, root)
    if pointer is None:
        raise ValueError(f"no generation is in force under {root}")
    old = pointer["folder"]
    units = publish.published(spark, old)
    if bad := tombstones.checked_ledger(ledger).where("problem IS NOT NULL").select("problem").distinct().collect():
        raise ValueError(f"the ledger has {[r[0] for r in bad]}")
    if ledger.isEmpty():
        raise ValueError("the ledger is empty")
    digest = tombstones.ledger_digest(ledger).first()["digest"]
    after, counts = tombstones.apply_tombstones(units, ledger, snapshot_id)
    told = counts.first().asDict()
    result = {"ledger": digest, "prior": old, "counts": told, "executed": {"backup": False, "propagation": False, "publication": False}}
    if not told["matched"]:
        return result | {"status": "no_op", "current": old}
    before = publish.fingerprint(units)
    identity = {"of": publish.read_manifest(spark, old)["run_id"], "fingerprint": before}
    publish.publish(units, backup, identity)
    if publish.fingerprint(publish.published(spark, backup)) != before:
        raise ValueError("the backup isn't what was backed up")
    result["executed"]["backup"] = True
    staged = f"{root}/generation-{publish.identity_hash(identity | {'ledger': digest})[:16]}"
    manifest = publish.publish(after, staged, identity | {"ledger": digest}, {"counts": told})
    if manifest["rows"] != units.count() - told["deleted"]:
        raise ValueError("the new generation doesn't have the rows that it should")
    result["executed"]["propagation"] = True
    changed = publish.fingerprint(publish.published(spark, staged)) != before
    if changed:
        publish.switch(spark, root, staged, seen)  # a generation that came meanwhile isn't overwritten
    result["executed"]["publication"] = changed
    return result | {"status": "applied", "current": staged if changed else old, "backup": backup}


def run_operation(spark: SparkSession, outbox: DataFrame, root: str, ledger: DataFrame, snapshot_id: str, backup: str, now: str) -> tuple[DataFrame, dict]:
    """(outbox, reconciliation): registers a ledger's deletion, checks what is left of it to do, replays it if it failed before, purges and records.

    A deletion that is in progress elsewhere is an error; one that was applied, and of which nothing is left to do, is not run again.
    """
    digest = tombstones.ledger_digest(ledger).first()["digest"]
    identity = publish.identity_hash({"ledger": digest, "snapshot_id": snapshot_id, "root": root})
    row = spark.createDataFrame([(identity, f"{snapshot_id}:{root}", ledger.count())], "identity string, scope string, records bigint")
    box = publish.written(state.register(outbox, row, now))
    status = box.where(F.col("identity") == identity).first()["status"]
    if status == "in_progress":
        raise ValueError("this deletion is in progress; recover stale claims first")
    left = tombstones.apply_tombstones(publish.published(spark, publish.current(spark, root)), ledger, snapshot_id)[1].first()["matched"]
    if status == "applied" and not left:
        return box, {"identity": identity, "status": "no_op", "precheck": left}
    again = F.when(F.col("identity") == identity, F.lit("failed")).otherwise(F.col("status"))
    mine = box if status == "pending" else state.replay(box.withColumn("status", again).where(F.col("identity") == identity), now).unionByName(box.where(F.col("identity") != identity))
    others = mine.where(F.col("identity") != identity)
    claimed = publish.written(state.claim(mine.where(F.col("identity") == identity), 1, now))
    try:
        result = purge(spark, root, ledger, snapshot_id, backup)
        outcome = [(identity, result["counts"]["matched"], result["counts"]["deleted"], None)]
    except Exception as error:  # what went wrong is recorded, and can be replayed
        result = {"status": "failed", "error": str(error)}
        outcome = [(identity, None, None, str(error)[:500])]
    done = state.complete(claimed, spark.createDataFrame(outcome, "identity string, observed bigint, deleted bigint, error string"), now)
    return publish.written(others.unionByName(done)), result | {"identity": identity, "precheck": left}


def audit_by_source(spark: SparkSession, sources: DataFrame, records: Callable[[list[str]], DataFrame], corpus_units: DataFrame, resolved: DataFrame, out: str, at_once: int = 1000) -> DataFrame:
    """Matches (exposure_id, source_id, line) over all sources; a source that was audited before, with the same content, corpus and exposures, isn't read again.

    records gives the identities (source_id, line, four fields) of the sources that are named to it. New sources are audited
    at_once to a job and published as one run, whose manifest says which contents it holds; a failure loses no earlier run.
    """
    common = {"exposures": publish.fingerprint(resolved), "corpus": publish.fingerprint(corpus_units)}
    wanted = {publish.identity_hash(common | f): f["source_id"] for f in archive.facts(spark, sources)}
    runs = publish.listed(spark, f"{out}/runs", "run=")
    held: dict[str, int] = {}
    for k in runs:
        if manifest := publish.read_manifest(spark, f"{out}/runs/run={k}"):
            held |= {content: k for content in manifest["contents"] if content in wanted}
    every = sorted((s, c) for c, s in wanted.items() if c not in held)
    for first in range(0, len(every), at_once):
        new = {c: s for s, c in every[first : first + at_once]}
        number = max([*runs, *held.values()], default=-1) + 1
        named = spark.createDataFrame(list(new.items()), "content string, source_id string")
        hits = audit.targeted(records(sorted(new.values())), resolved).join(resolved.where("identified").select("exposure_id", *audit.KEYS), list(audit.KEYS)).select("exposure_id", "source_id", "line").distinct()
        publish.publish(hits.join(F.broadcast(named), "source_id"), f"{out}/runs/run={number}", common | {"contents": sorted(new)}, {"contents": sorted(new)})  # a row for each file is broadcast
        held |= dict.fromkeys(new, number)
    found = spark.createDataFrame([], "exposure_id string, source_id string, line bigint")
    for k in sorted(set(held.values())):
        mine = spark.createDataFrame([(c,) for c, n in held.items() if n == k], "content string")
        found = found.unionByName(publish.published(spark, f"{out}/runs/run={k}").join(F.broadcast(mine), "content", "left_semi").drop("content"))
    return found


def archive_index(records: DataFrame, folder: str, identity: dict, buckets: int = 64) -> DataFrame:
    """Publishes archive records (source_id, line, four fields) in buckets of a hash of their identity, for matches that don't move them."""
    return publish.bucketed(records.withColumn("identity", F.xxhash64(*audit.KEYS)), folder, identity, "identity", buckets)


def match_indexed(spark: SparkSession, folder: str, resolved: DataFrame) -> DataFrame:
    """match_exposures on an archive_index: only the exposures move."""
    index = publish.open_bucketed(spark, folder)
    wanted = resolved.where("identified").withColumn("identity", F.xxhash64(*audit.KEYS)).select("exposure_id", "identity", *[F.col(k).alias(f"__{k}") for k in audit.KEYS])
    same = F.lit(True)
    for k in audit.KEYS:
        same = same & (F.col(k) == F.col(f"__{k}"))
    hits = index.join(wanted, "identity").where(same).select("exposure_id", "source_id", "line")
    return audit.matched(resolved, hits)


def rematch(spark: SparkSession, index: str, run_id: str, resolved: DataFrame) -> DataFrame:
    """match_exposures on a published index of archive records; an error if it isn't the run that it should be."""
    manifest = publish.read_manifest(spark, index)
    if manifest is None or manifest["run_id"] != run_id:
        raise ValueError(f"{index} isn't the run {run_id}")
    return audit.match_exposures(resolved, publish.published(spark, index))


def package(spark: SparkSession, folders: list[str], out: str) -> dict:
    """Copies published datasets into one folder and checks that their rows came along."""
    rows = {}
    for f in folders:
        name = f.rstrip("/").rsplit("/", 1)[-1]
        source = publish.read_manifest(spark, f)
        copied = publish.publish(publish.published(spark, f), f"{out}/{name}", source["identity"])
        if copied["rows"] != source["rows"]:
            raise ValueError(f"{name} lost rows")
        rows[name] = copied["rows"]
    return rows


@dataclass
class Telemetry:
    """Observations that were made, never inferred: an unknown one stays null."""

    observations: dict[str, float | None] = field(default_factory=dict)

    def observe(self, name: str, value: float | None) -> None:
        if value is not None and (value != value or value < 0):
            raise ValueError(f"{name} can't be {value}")
        self.observations[name] = value

    def report(self, names: list[str]) -> dict[str, float | None]:
        return {n: self.observations.get(n) for n in names}


def doctor(spark: SparkSession, folder: str = "/tmp") -> dict:
    """What a run would find: versions, parallelism, free disk, whether a shared checkpoint folder is set."""
    return {
        "python": platform.python_version(), "pyspark": pyspark.__version__, "spark": spark.version, "parallelism": spark.sparkContext.defaultParallelism, "free_disk_bytes": shutil.disk_usage(folder).free,
        "checkpoint_dir": spark.conf.get("spark.checkpoint.dir", None), "adaptive": spark.conf.get("spark.sql.adaptive.enabled"), "ansi": spark.conf.get("spark.sql.ansi.enabled"),
    }
