from tarnwick.sources.tables import latest, load

__all__ = ["latest", "load"]
