"""Ledger and tax-credit reconciliation as Spark jobs."""

from tallyfold.session import build_session

__all__ = ["build_session"]
