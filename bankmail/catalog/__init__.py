"""Every registered query, by section."""

from bankmail.catalog.registry import ORACLES, QUERIES


def load() -> None:
    """Import the sections, which fill QUERIES and ORACLES."""
    from importlib import import_module

    for section in ("ingest", "spending", "text", "search", "maintain", "streams", "stored"):
        import_module(f"bankmail.catalog.{section}")


__all__ = ["ORACLES", "QUERIES", "load"]
