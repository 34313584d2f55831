"""The library's queries over the driver's tables, and their DuckDB SQL."""

from __future__ import annotations

from siltstone.plans import cohorts, core, flagship, reports, structure

FLAGSHIP = flagship.FLAGSHIP
MODULES = (core, structure, reports, flagship, cohorts)  # their queries register themselves on import

QUERIES = core.QUERIES
SQL = core.SQL
