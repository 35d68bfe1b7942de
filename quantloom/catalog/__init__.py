"""Registered queries, grouped by theme."""

from quantloom.catalog import bars, features, sections, studies
from quantloom.catalog.studies import flagship

ALL = [bars.C, features.C, sections.C, studies.C]

__all__ = ["ALL", "flagship"]
