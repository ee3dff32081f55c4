"""Structured Streaming: progress of runs while they go on (an extension)."""
