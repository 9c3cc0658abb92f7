"""Named queries (``catalog``) and their independent DuckDB SQL (``oracle``)."""
