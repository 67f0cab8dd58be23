"""lakecheck: table loads, rule checks, reconciliation and audit analytics as PySpark DataFrame operators."""

from lakecheck.session import build_session, scratch_folder

__all__ = ["build_session", "scratch_folder"]
