"""Structured Streaming forms of the unattended run."""
