"""Whole evaluations: rolling backtests, grids of cells, run identity and manifests."""
