"""What the engine can do, and questions about it. The one engine is Spark; its name among others is "pyspark"."""

from __future__ import annotations

from typing import Any

ENGINE = "pyspark"
CAPABILITIES = {
    "schema_validation": True, "profiling": True, "aggregation_analyzers": True, "bifurcation": True, "streaming": True, "batch": True, "sql": True,
    "transpile": True, "streaming_totals": True, "pushdown": True, "excel": True,
}


def detect_engine(df: Any) -> str:
    """The engine that a DataFrame belongs to; TypeError for anything but Spark's."""
    if any(c.__module__.startswith("pyspark.sql") and c.__name__ == "DataFrame" for c in type(df).__mro__):
        return ENGINE
    raise TypeError(f"not a Spark DataFrame: {type(df).__module__}.{type(df).__name__}; createDataFrame makes one of it")


def get_capabilities(engine: str = ENGINE) -> dict[str, bool]:
    """All capabilities; none of an engine that isn't known."""
    return dict(CAPABILITIES) if engine == ENGINE else {}


def has_capability(engine: str, capability: str) -> bool:
    return get_capabilities(engine).get(capability, False)


def list_engines_with_capability(capability: str) -> list[str]:
    return [ENGINE] if CAPABILITIES.get(capability) else []


def require_capability(df: Any, capability: str, feature: str = "this feature") -> None:
    """Raise NotImplementedError if the engine of df hasn't the capability."""
    if not has_capability(detect_engine(df), capability):
        raise NotImplementedError(f"{feature} needs '{capability}', which {ENGINE} has not here; it has {', '.join(k for k, v in CAPABILITIES.items() if v)}")
