"""Registered queries of the windows in chunks; their oracle SQL is that of the same windows, by self-joins."""

from __future__ import annotations

from ..plans import stated
from ..plans.dialect import REGISTRY
from ..sources.views import fleet_views
from . import chunks

#: Rows and seconds of a chunk here: small, so that the test tables' vehicles are of several chunks.
ROWS, SPAN = 128, 86400

#: query: the operator, the views it needs, and its form in chunks.
FORMS = {
    "e14_in_chunks": ("e14_rolling_efficiency", ("telemetry",), chunks.rolling_efficiency, {"chunk": ROWS}),
    "m1_in_chunks": ("m1_maintenance_features", ("telemetry", "vehicles"), chunks.maintenance_features, {"chunk": ROWS}),
    "n8_in_chunks": ("n8_rolling_features", ("readings",), chunks.rolling_features, {"chunk": ROWS}),
    "n9_in_chunks": ("n9_lag_features", ("readings",), chunks.lag_features, {"chunk": ROWS}),
    "w11_in_chunks": ("w11_rolling_zscore", ("readings",), chunks.rolling_zscore, {"chunk": ROWS}),
    "w15_in_chunks": ("w15_sessionize", ("readings",), chunks.sessionize, {"chunk": ROWS}),
    "w25_in_chunks": ("w25_rollup_over_time", ("readings",), chunks.rollup_over_time, {"span_s": SPAN}),
}


def queries() -> dict:
    def bind(op, views, form, given):
        return lambda spark, sf_dir: form(**fleet_views(spark, sf_dir, views), **REGISTRY[op].given, **given)

    return {key: bind(*spec) for key, spec in FORMS.items()}


def oracle_sql() -> dict[str, str]:
    texts = stated.oracle_sql()
    return {key: texts[op] for key, (op, *_) in FORMS.items()}
