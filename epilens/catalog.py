"""All queries of the engine, and the DuckDB SQL that each must equal."""

from __future__ import annotations

from epilens.operators import articles, assess, cluster, clusterbuild, disease, duplicates, gazetteer, links, merge, places, placetext, scoring, triage, upkeep, weblinks  # noqa: F401
from epilens.plans import alerts, decision, details, exports, lists, maps, queue, report, rollup, texts, trend  # noqa: F401
from epilens.sources import files, masterdata  # noqa: F401
from epilens.streaming import alerts as alert_streams, daily  # noqa: F401
from epilens.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
