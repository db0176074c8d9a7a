"""Tidemark: event-journal analytics and durable dataflow on Spark DataFrames."""
