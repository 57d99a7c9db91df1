"""Works as a stream."""
