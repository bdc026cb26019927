"""Independent DuckDB SQL for every exactly-checkable query (the correctness oracle)."""
