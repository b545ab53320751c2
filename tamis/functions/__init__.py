"""Column functions: fail predicates of row checks, aggregates of table checks."""
