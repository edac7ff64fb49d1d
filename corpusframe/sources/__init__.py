"""Sources and sinks: files, collections, change history, index state."""
