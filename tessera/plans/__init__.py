"""Query plans by operator family."""
