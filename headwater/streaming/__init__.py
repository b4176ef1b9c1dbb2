"""Structured Streaming forms of stateless operators. The studied design has no streaming; this is an extra."""
