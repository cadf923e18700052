"""Operators that turn a catalogue's transcripts into training data: one module per operator."""
