"""DataFrame operators: bars, positions, scoring, risk tests, inference, economics."""
