from lakecheck.sinks import compact, merge, versions, writers

__all__ = ["compact", "merge", "versions", "writers"]
