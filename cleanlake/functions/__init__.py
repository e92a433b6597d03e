"""Column-level building blocks: predicates, clocks, formats, payloads, content types."""
