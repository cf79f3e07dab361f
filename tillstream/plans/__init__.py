"""Registered queries over the driver tables, each with its SQL oracle."""

from importlib import import_module

MODULES = ("sources_q", "filters_q", "joins_q", "aggregates_q", "series_q", "ranking_q", "functions_q",
           "demand_q", "evaluate_q", "router_q", "targets_q", "whatif_q", "quality_q", "features_q", "models_q",
           "streaming_q")


def load_all() -> None:
    for m in MODULES:
        import_module(f"{__name__}.{m}")
