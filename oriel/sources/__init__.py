"""Readers and writers: bar files, minute archives, synthetic paths, the results store."""
