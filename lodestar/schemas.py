"""The register of sources, and the words that labels may hold."""

from __future__ import annotations

SOURCE = "source_id string, path string, source_kind string, declared_month string, source_role string, usage_scope string, expected_checksum string, status string"

#: The words a label field may hold.
TOPIC_FIT = ("yes", "no", "unknown")
SPEAKER_INTENT = ("seeking_solution", "describing_pain", "sharing_experience", "answering_someone", "self_promotion", "quoting", "unknown")
PRODUCT_FIT = ("compatible", "incompatible", "needs_clarification", "not_evaluated")
RESOLUTION = ("resolved", "no_resolution_observed", "unknown")
ATTRIBUTION = ("focal_author", "quoted_other", "uncertain")
SUPPORTS = ("topic_fit", "need_clarity", "author_requirement", "product_fit")
