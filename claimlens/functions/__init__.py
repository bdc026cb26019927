"""Column-level functions (JVM-side expressions only; no Python UDFs)."""
