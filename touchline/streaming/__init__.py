"""streaming of the decision-value engine."""
