"""Flux towers: the same functions in batch and as a stream, and the stream sink."""
