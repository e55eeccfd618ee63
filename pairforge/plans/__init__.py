"""SQL dialect, query runner, orchestration and the registered queries."""
