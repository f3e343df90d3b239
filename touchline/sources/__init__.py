"""sources of the decision-value engine."""
