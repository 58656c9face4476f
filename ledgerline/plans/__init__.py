"""Queries over the driver tables, each with its SQL for an independent engine."""

from ledgerline.plans import cases, classes, reports, shaping, star, statements, texts  # noqa: F401  all register their queries

QUERIES: dict = dict(star.QUERIES)
ORACLE: dict = dict(star.ORACLE)
