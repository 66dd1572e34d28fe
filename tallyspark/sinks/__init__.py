"""Results as text tables and CSV, entries as ledger text, and the formatter of ledger files."""
