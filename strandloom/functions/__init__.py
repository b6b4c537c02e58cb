"""Column builders: numbers, ordering keys, text, sequences, tail probabilities."""
