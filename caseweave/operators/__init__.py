"""DataFrame operators: counting, allocation, running totals, concentration, resampling, smoothing."""
