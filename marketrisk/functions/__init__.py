"""Column helpers: guarded math, frames, decayed averages, ordered blocks, exact quantiles."""
