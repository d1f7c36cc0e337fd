"""Text forms used in reports."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .urls import _col


def fmt_commit_date(ts: Column | str) -> Column:
    """``dd/MM/yyyy HH:mm:ss UTC`` (the session time zone must be UTC)."""
    return F.concat(F.date_format(_col(ts), "dd/MM/yyyy HH:mm:ss"), F.lit(" UTC"))


def finding_label(path: Column | str, key_name: Column | str, secret_type: Column | str) -> Column:
    """``path (key_name: secret_type)``."""
    return F.concat(
        _col(path), F.lit(" ("), _col(key_name), F.lit(": "), _col(secret_type), F.lit(")")
    )


def secret_status(n_secrets: Column | str) -> Column:
    return F.when(_col(n_secrets) > 0, F.lit("Secrets Found")).otherwise(
        F.lit("No secrets detected")
    )
