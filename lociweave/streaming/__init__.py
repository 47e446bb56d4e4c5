"""Annotation of Structured Streaming inputs."""
