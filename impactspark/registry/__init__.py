"""Named queries over the sample tables, each with the SQL that checks it."""

from impactspark.registry import dashboards, learned, people, policy, profile, tables  # noqa: F401
from impactspark.registry.base import ENTRIES

__all__ = ["ENTRIES"]
