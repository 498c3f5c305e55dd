"""Every named query of the library with its checking SQL."""

from __future__ import annotations

from chorus.catalog.registry import REGISTRY, Query

from chorus.catalog import (features, ingest, predictions, stats, streams, text,  # noqa: E402,F401
                            training)

__all__ = ["REGISTRY", "Query"]
