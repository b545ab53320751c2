"""Plans: rules bound to a schema and fused, and the same rules as SQL text."""
