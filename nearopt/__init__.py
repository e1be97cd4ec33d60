"""Sets of near-optimal generalised linear models over DataFrames: fit, certify, sample, and measure their spread."""
