"""Readers and writers: ledger tables, prices, catalog, transcripts, results."""
