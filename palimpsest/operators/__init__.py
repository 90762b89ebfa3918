"""Operators on DataFrames: matching, sequences, roll-ups, sets."""
