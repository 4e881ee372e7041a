"""The catalogue of named queries, by area."""

from __future__ import annotations

from lodestar.plans import base, completions, entities, files, further, geometry, registry, sparse, streams, telemetry  # noqa: F401  registration


def queries() -> dict:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.ORACLES)
