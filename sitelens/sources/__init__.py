"""Sources and sinks: input tables, captured responses, stored tables."""
