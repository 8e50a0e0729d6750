"""Part of the restoration engine."""
