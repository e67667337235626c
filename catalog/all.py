from catalog import describe, distributions, inference, matrices, models, peaks, signals, tables  # noqa: F401
