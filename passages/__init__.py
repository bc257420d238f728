"""Passages: transcripts and documents to passages, vectors, context and prompts on Spark."""
