"""Column builders: colour and tone mathematics, names and durations, clocks."""
