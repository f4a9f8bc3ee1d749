"""Relational operators: retrieval, selection, ledger, validation, batch answering."""
