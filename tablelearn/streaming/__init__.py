"""Streaming: apply fitted parameter tables to a Structured Streaming source."""
