"""Index large collections of repositories and analyse agent activity with Spark."""

from corpusmap.options import ScanOptions

__all__ = ["ScanOptions"]
