"""The library's named queries, by theme."""

from tessera.plans import aggregates, fields, flows, graphs, joins, mining, observability, orchestration, paging, scalars, scans, series, sets, warehouse, windows  # noqa: F401
