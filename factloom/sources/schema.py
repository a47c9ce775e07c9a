"""Schemas of the fact tables. Every table has snapshot_id, and a dataset is partitioned by it."""

from __future__ import annotations

TABLES = {
    "files": "snapshot_id string; relative_path string; extension string; language string; size_bytes long; content_hash string",
    "symbols": "snapshot_id string; fact_id string; name string; kind string; relative_path string; language string; line_number long; evidence_class string",
    "imports": "snapshot_id string; fact_id string; importer_path string; import_spec string; line_number long; language string; kind string; resolved_path string; evidence_class string",
    "verification_targets": "snapshot_id string; label string; scope_root string; working_directory string; command array<string>; kind string; priority string",
    "snapshots": "snapshot_id string; root string; revision string; captured_at string; excluded_roots array<string>; languages array<string>",
    "obligations": "id string; source_pair string; contract_id string; assumptions array<string>; encoding_hash string",
    "certificates": "obligation_id string; encoding_hash string; status string; solver string; timeout_ms long; assumptions array<string>; witness string",
}


def ddl(name: str) -> str:
    """The table's schema as DDL."""
    return ", ".join(x.strip() for x in TABLES[name].split(";"))


# Enumerations in their order, which sorting follows.
EDGE_KINDS = ("contains", "defines", "imports", "references", "calls", "builds", "tests", "documents", "supports_decision")
TARGET_KINDS = ("test", "typecheck", "quality")
PRIORITIES = ("required", "recommended")
JSON_ALIASES = {"background_job": "background_worker", "xtask-perf": "xtask_perf", "j_s_import": "js_import"}
