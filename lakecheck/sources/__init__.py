from lakecheck.sources import audit_files, files, listing, sql

__all__ = ["audit_files", "files", "listing", "sql"]
