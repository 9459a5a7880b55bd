"""Column builders: geometry and binary decoding."""
