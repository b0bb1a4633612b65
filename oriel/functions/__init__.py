"""Column expressions: variance proxies, scoring rules, predictive distributions."""
