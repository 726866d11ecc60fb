"""Registered queries, one module per family."""

from importlib import import_module

from millrace.plans.registry import COVERS, ORACLES, QUERIES

FAMILIES: tuple[str, ...] = (
    "feature_queries",
    "profile_queries",
    "sql_queries",
    "evaluation_queries",
    "preparation_queries",
    "corpus_queries",
    "retrieval_queries",
    "registry_queries",
    "run_queries",
    "source_queries",
    "model_queries",
    "whatif_queries",
    "stream_queries",
)


def load() -> None:
    for family in FAMILIES:
        import_module(f"millrace.plans.{family}")


load()

__all__ = ["COVERS", "ORACLES", "QUERIES"]
