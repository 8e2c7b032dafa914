"""Part of the causal engine."""
