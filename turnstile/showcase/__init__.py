"""Every operator on the test tables, with a SQL twin where SQL has one."""

from turnstile.showcase import data, features, gold, ingest, silver  # noqa: F401
from turnstile.showcase.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
