"""Column functions: text cleaning, audio codes, audio samples."""
