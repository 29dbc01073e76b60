"""Interactive shells: statements, and commands on one table."""
