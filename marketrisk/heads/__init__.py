"""Prediction heads on MLlib: classifiers, volatility, quantiles, stacking and blends."""
