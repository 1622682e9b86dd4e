"""Column expressions: text cleaning, channels, time buckets, ratios."""
