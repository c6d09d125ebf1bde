"""The rail model projected from the given tables, and every query beside its SQL twin; all of them once this package is imported."""

from . import audits, details, edits, flagship, queries, records  # noqa: F401
