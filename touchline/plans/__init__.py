"""plans of the decision-value engine."""
