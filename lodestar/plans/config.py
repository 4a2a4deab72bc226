"""Strict configurations: every field is declared, with its default and what it may hold; an unknown field is an error."""

from __future__ import annotations

import glob
import hashlib
import os
from collections.abc import Callable
from urllib.parse import urlparse

from ..sources.archive import load_config, scenarios_of
from .publish import canonical_json


def _whole(least: int, most: int | None = None) -> Callable[[object], bool]:
    return lambda v: isinstance(v, int) and not isinstance(v, bool) and v >= least and (most is None or v <= most)


def _one_of(*values: object) -> Callable[[object], bool]:
    return lambda v: any(v == x and type(v) is type(x) for x in values)


def _text(v: object) -> bool:
    return isinstance(v, str)


def _text_or_none(v: object) -> bool:
    return v is None or isinstance(v, str)


_FLAG = _one_of(False, True)
_SEED = lambda v: isinstance(v, int) and not isinstance(v, bool)

#: Sections of the runtime configuration, their fields, defaults and tests.
RUNTIME = {
    "network": {"allow_model_downloads": (False, _FLAG), "allow_remote_inference": (False, _FLAG), "allow_reddit_requests": (False, _FLAG), "allow_auto_publish": (False, _FLAG)},
    "paths": {"data_dir": ("./data", _text), "reports_dir": ("./reports", _text), "sqlite_path": ("./data/sqlite/search.db", _text)},
    "ingestion": {
        "max_line_bytes": (8_388_608, _whole(1)), "batch_records": (2_000, _whole(1)), "checkpoint_interval_records": (5_000_000, _whole(1)), "shard_target_records": (10_000, _whole(1)), "reader_workers": (1, _one_of(1)),
        "on_bad_json": ("quarantine_and_mark_incomplete", _one_of("quarantine_and_mark_incomplete")), "on_decompression_error": ("fail", _one_of("fail")),
        "max_staging_bytes": (10_737_418_240, _whole(1)), "minimum_free_disk_bytes": (5_368_709_120, _whole(0)), "max_process_rss_bytes": (4_294_967_296, _whole(1)),
    },
    "sampling": {"seed": (20_260_907, _SEED), "pilot_target_units": (30_000, _whole(1)), "rejected_control_target": (1_000, _whole(0))},
    "context": {"max_parent_messages": (4, _whole(0)), "focus_chunk_tokens": (512, _whole(1)), "focus_overlap_tokens": (64, _whole(0)), "retrieval_context_tokens": (1_024, _whole(1)), "evaluation_context_tokens": (4_096, _whole(1))},
    "retrieval": {
        "lexical_candidates_per_scenario": (100, _whole(1)), "dense_candidates_per_scenario": (100, _whole(1)), "rrf_k": (60, _whole(1)), "rerank_candidates": (100, _whole(1)), "feedback_candidates": (100, _whole(1)),
        "max_feedback_rounds": (1, _whole(0, 1)), "final_review_candidates": (40, _whole(1)), "output_limit": (20, _whole(1)), "output_max_questions_per_thread": (3, _whole(1)),
    },
    "models": {
        "embedding_id": ("Qwen/Qwen3-Embedding-0.6B", _text), "embedding_revision": (None, _text_or_none), "embedding_dimension": (1_024, _whole(1)), "reranker_id": ("Qwen/Qwen3-Reranker-0.6B", _text),
        "reranker_revision": (None, _text_or_none), "device": ("auto", _one_of("auto", "cpu", "mps", "cuda")), "batch_size": (8, _whole(1)),
    },
    "qdrant": {"url": ("http://127.0.0.1:6333", _text)},
    "review": {"mode": ("manual", _one_of("manual", "model", "mock")), "evaluator_backend": (None, _text_or_none), "remote_request_budget": (0, _whole(0))},
    "feedback": {"enabled": (False, _FLAG), "strategy": ("average_vector", _one_of("average_vector")), "max_positive_examples": (5, _whole(0, 5)), "max_negative_examples": (5, _whole(0, 5))},
}

#: Fields of the runtime configuration outside its sections, of a comparison and of a compared variant.
HEAD = {"schema_version": (1, _one_of(1)), "mode": ("pilot", _one_of("pilot")), "language_policy": ("english_first", _one_of("english_first"))}
COMPARISON = {
    "schema_version": (1, _one_of(1)), "snapshot_id": (None, lambda v: _text(v) and v.strip() != ""), "split": ("test", _one_of("dev", "test")), "output_limit": (None, _whole(1)), "review_budget": (None, _whole(1)),
    "lexical_candidates": (None, _whole(1)), "dense_candidates": (None, _whole(1)), "rerank_candidates": (None, _whole(1)), "feedback_candidates": (None, _whole(1)), "rrf_k": (None, _whole(1)),
}
VARIANT = {"variant_id": (None, _one_of("A", "B", "C")), "lexical": (None, _FLAG), "dense": (None, _FLAG), "reranker": (None, _FLAG), "feedback": (None, _FLAG)}

#: The lists of claims of a product profile.
CLAIM_LISTS = ("platforms", "capabilities", "pricing_claims", "device_constraints", "unsupported_requirements", "limitations")


def configuration_hash(config: dict) -> str:
    return hashlib.sha256(canonical_json(config)).hexdigest()


def _checked(given: object, fields: dict, where: str) -> dict:
    """given with the defaults of fields that it lacks; an error for other fields and for values that fail their test."""
    if not isinstance(given, dict):
        raise ValueError(f"{where} must be a mapping")
    if more := sorted(set(given) - set(fields)):
        raise ValueError(f"{where} has unknown fields: {more}")
    out = {name: given.get(name, default) for name, (default, _) in fields.items()}
    if bad := [name for name, (_, test) in fields.items() if not test(out[name])]:
        raise ValueError(f"{where} has values that aren't allowed: {bad}")
    return out


def runtime_config(given: dict) -> dict:
    """A whole runtime configuration from a partial one."""
    out = _checked({k: v for k, v in given.items() if k not in RUNTIME}, HEAD, "the runtime configuration")
    out |= {section: _checked(given.get(section, {}), fields, section) for section, fields in RUNTIME.items()}
    if out["context"]["focus_overlap_tokens"] >= out["context"]["focus_chunk_tokens"]:
        raise ValueError("chunks must be longer than their overlap")
    if out["network"]["allow_remote_inference"] and not out["review"]["remote_request_budget"]:
        raise ValueError("remote inference needs a budget of requests")
    if out["review"]["mode"] == "model" and not out["review"]["evaluator_backend"]:
        raise ValueError("review by a model needs a backend")
    return out


def comparison_config(given: dict) -> dict:
    """A configuration of the comparison of the variants A, B and C."""
    out = _checked({k: v for k, v in given.items() if k != "variants"}, COMPARISON, "the comparison")
    out["variants"] = [_checked(v, VARIANT, "a variant") for v in given.get("variants", [])]
    if [v["variant_id"] for v in out["variants"]] != ["A", "B", "C"]:
        raise ValueError("a comparison has the variants A, B and C, in this order")
    if out["output_limit"] > out["review_budget"]:
        raise ValueError("more output than review")
    return out


def profiles(folder: str) -> list[dict]:
    """Product profiles of a folder, by file name; app ids, and claim ids within a profile, must differ."""
    found = [load_config(f) for f in _files(folder)]
    for p in found:
        claims = [c["claim_id"] for kind in CLAIM_LISTS for c in p.get(kind, [])]
        if not p.get("app_id") or not _whole(1)(p.get("profile_version")) or len(set(claims)) < len(claims):
            raise ValueError(f"bad profile {p.get('app_id')}")
    if len({p["app_id"] for p in found}) < len(found):
        raise ValueError("app ids stand twice")
    return found


def missing_evidence(profile: dict) -> list[str]:
    """Claims of a profile that are not verified with evidence."""
    claims = [c for kind in CLAIM_LISTS for c in profile.get(kind, [])]
    return sorted(c["claim_id"] for c in claims if c.get("status") != "verified" or not c.get("evidence_ref"))


def scenarios(folder: str) -> list[dict]:
    """Scenarios of a folder's files, by file name; ids must differ, and claims need an app."""
    found = scenarios_of({"scenarios": [s for f in _files(folder) for s in load_config(f)["scenarios"]]})
    if bad := [s["scenario_id"] for s in found if s.get("required_claim_ids_for_fit") and s.get("app_id") is None]:
        raise ValueError(f"claims without an app: {bad}")
    return found


def _files(folder: str) -> list[str]:
    return sorted(f for kind in ("yaml", "yml", "json") for f in glob.glob(os.path.join(folder, f"*.{kind}")))


def retrieval_preflight(runtime: dict, comparison: dict) -> dict:
    """What a comparison would run into: ready, blockers, checks and the configurations' hashes. Nothing is loaded or called."""
    checks: dict[str, bool] = {}
    blockers: list[str] = []
    known: dict[str, dict] = {}

    def check(name: str, holds: bool, told: str) -> None:
        checks[name] = holds
        if not holds:
            blockers.append(told)

    for name, read, given in (("runtime", runtime_config, runtime), ("comparison", comparison_config, comparison)):
        try:
            known[name] = read(given)
            check(f"{name}_config_valid", True, "")
        except ValueError as error:
            check(f"{name}_config_valid", False, f"{name} config: {error}")
    if run := known.get("runtime"):
        network, models = run["network"], run["models"]
        check("local_only_policy", not any(network[k] for k in ("allow_model_downloads", "allow_remote_inference", "allow_reddit_requests")), "the network policy allows calls to others")
        for kind in ("embedding", "reranker"):
            check(f"{kind}_revision_pinned", bool(models[f"{kind}_revision"]), f"no pinned revision of the {kind} model")
        url = urlparse(run["qdrant"]["url"])
        check("qdrant_url_loopback", url.scheme in ("http", "https") and url.hostname in ("127.0.0.1", "localhost", "::1"), "the vector service isn't on this machine")
        if plan := known.get("comparison"):
            same = all(plan[k] == run["retrieval"][k] for k in ("output_limit", "rrf_k"))
            check("comparison_matches_runtime_limits", same, "comparison and runtime have other limits")
    return {"ready": not blockers, "blockers": blockers, "checks": dict(sorted(checks.items()))} | {f"{k}_configuration_hash": configuration_hash(known[k]) if k in known else None for k in ("runtime", "comparison")}


def resolve_alias(registry: dict, alias: str) -> tuple[str, str] | None:
    """(collection, snapshot) that a registry of entries has under an alias."""
    for entry in registry.get("entries", []):
        if entry.get("alias") == alias and isinstance(entry.get("collection"), str) and isinstance(entry.get("snapshot_id"), str):
            return entry["collection"], entry["snapshot_id"]
    return None
