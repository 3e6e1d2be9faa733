"""memspark: long-term memory analytics as DataFrame, SQL and Structured Streaming plans."""
