"""A PySpark engine for event-driven market research: bars, factors, labels, discovery and validation as DataFrame plans."""
