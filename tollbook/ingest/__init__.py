"""Transcript records -> ledger rows, one module per harness."""
