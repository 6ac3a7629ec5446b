"""Views over the driver tables, and the catalogue of queries with their SQL."""

from importlib import import_module

MODULES = ("annotation", "circular", "scalars", "registry", "spatial", "studies", "pipeline", "governance", "rooms", "shaping", "refuge", "imaging", "mirrors", "windows")


def load() -> None:
    """Fill the catalogue."""
    for m in MODULES:
        import_module(f".{m}", __name__)
