"""Column-level building blocks: text, ids, scope, redaction, tokens, scoring, rendering."""
