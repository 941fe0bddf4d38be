"""Structured Streaming: reads as files arrive, and change points of endless signals."""
