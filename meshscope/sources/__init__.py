"""Sources and sinks: declared schemas, readers, writers, derived test tables."""
