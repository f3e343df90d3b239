"""functions of the decision-value engine."""
