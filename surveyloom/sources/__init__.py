"""File, table and JDBC sources and sinks."""
