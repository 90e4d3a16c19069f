"""The study's inputs derived from the benchmark tables, and the queries registered on them."""
