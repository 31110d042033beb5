"""Part of the table-learning engine."""
