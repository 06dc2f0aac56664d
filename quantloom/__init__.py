"""Factor research on Spark: point-in-time tables, factor windows, cross-sections, evaluation, portfolios."""
