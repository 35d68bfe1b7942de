"""quantloom: panel analytics on price/volume bars, expressed as Spark jobs."""

from quantloom.settings import Settings

__all__ = ["Settings"]
