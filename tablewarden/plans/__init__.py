"""Query plans as evidence."""
