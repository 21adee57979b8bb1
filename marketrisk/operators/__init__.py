"""Operators on minute and daily tables, one module per family."""
