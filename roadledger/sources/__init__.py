"""Dimensions, file and stream sources, the ledger, and adapters from the test tables."""
