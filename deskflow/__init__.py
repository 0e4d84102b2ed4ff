"""Message, event and configuration dataflow as PySpark DataFrame, SQL and Structured Streaming code."""
