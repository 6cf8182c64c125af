"""Operators over utterances, codes, channels, examples, splits, statistics and sessions."""
