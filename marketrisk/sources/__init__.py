"""Reading, typing, checking and writing market tables."""
