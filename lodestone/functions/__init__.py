"""Value semantics: canonical strings, literals, rendering."""
