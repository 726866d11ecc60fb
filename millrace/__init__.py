"""Spark jobs for the data work behind a machine-learning workspace."""

from millrace.session import build_session, scratch_path

__all__ = ["build_session", "scratch_path"]
