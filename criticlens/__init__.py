"""criticlens: review and product analytics as Spark DataFrame operators."""

from criticlens.session import build_session, stage

__all__ = ["build_session", "stage"]
