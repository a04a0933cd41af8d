"""Vector search over catalogs, and corpus preparation, on Spark."""

_PLACES = {
    "Catalog": "tessera.plans.catalog", "Filters": "tessera.plans.catalog", "SearchOutcome": "tessera.plans.catalog", "Router": "tessera.operators.router", "RouterConfig": "tessera.operators.router",
    "block_topk": "tessera.operators.search", "kmeans_shards": "tessera.operators.shards", "shard_table": "tessera.operators.shards", "build_order": "tessera.operators.ordering", "calibrate": "tessera.operators.evaluation",
    "create_provider": "tessera.functions.text", "embed": "tessera.functions.text", "load_config": "tessera.sources.config", "estimate": "tessera.plans.capacity", "build_streaming": "tessera.streaming.build",
}
__all__ = sorted(_PLACES)


def __getattr__(name: str):
    """Names are imported when they are used, so that Python workers load only what they need."""
    if name in _PLACES:
        import importlib

        return getattr(importlib.import_module(_PLACES[name]), name)
    raise AttributeError(name)
