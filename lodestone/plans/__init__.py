"""From statement text to a checked logical plan."""
