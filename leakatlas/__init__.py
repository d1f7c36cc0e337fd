"""Secret-exposure analytics over tables of repositories, files and commits."""

from .plans.modes import list_mode, search_front, single_file_mode, whole_repo_mode
from .operators.scan import count_matches, redact, scan_secrets
from .rules import load_rules, rules_from_json, shipped_rules

__all__ = [
    "count_matches",
    "list_mode",
    "load_rules",
    "redact",
    "rules_from_json",
    "scan_secrets",
    "search_front",
    "shipped_rules",
    "single_file_mode",
    "whole_repo_mode",
]
