"""Structured Streaming forms of the triage, history, session and monitoring operators."""
