"""Column -> Column helpers (JVM-side built-ins only, no Python UDFs)."""
