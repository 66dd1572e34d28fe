"""Relational building blocks that the planner composes: inventories, summaries, prices, lots."""
