"""The registered queries and their SQL twins, one module per operator group."""

from __future__ import annotations

from importlib import import_module
from pathlib import Path


def load():
    """Import every catalog module and return (queries, SQL twins)."""
    from sightline.catalog import registry

    for module in sorted(path.stem for path in Path(__file__).parent.glob("*.py")):
        if module not in ("__init__", "registry", "views"):
            import_module(f"sightline.catalog.{module}")
    return registry.QUERIES, registry.TWINS
