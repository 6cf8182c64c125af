"""Conversational speech data jobs and corpus operators on Spark."""
