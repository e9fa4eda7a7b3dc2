"""The triage operators."""
