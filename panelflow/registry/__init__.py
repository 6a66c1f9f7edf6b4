"""Named, runnable queries over the star-schema tables."""

from importlib import import_module
from pathlib import Path

from panelflow.registry import core


def load():
    """Import every module of this folder; returns (queries, oracles)."""
    for f in sorted(Path(__file__).parent.glob("*.py")):
        if f.stem not in ("__init__", "core"):
            import_module(f"{__name__}.{f.stem}")
    return core.QUERIES, core.ORACLES
