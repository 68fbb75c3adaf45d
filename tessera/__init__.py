"""Panel analytics on PySpark: factor formulas, indicators, resampling, portfolio accounting."""
