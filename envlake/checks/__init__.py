"""Independent DuckDB SQL for the correctness gate, and a local comparison harness."""
