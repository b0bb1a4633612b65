"""Forecast models: native window expressions and block models on grouped Arrow batches."""
