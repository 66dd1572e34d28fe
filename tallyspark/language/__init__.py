"""The ledger query language: text to statements."""
