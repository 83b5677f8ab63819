"""Reading yearly register deliveries, and reading and writing results."""
