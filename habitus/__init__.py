"""Behavioural analytics over transaction tables and streams, expressed as Spark jobs."""
