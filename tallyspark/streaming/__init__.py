"""Following ledger files as they change."""
