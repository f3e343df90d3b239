"""operators of the decision-value engine."""
