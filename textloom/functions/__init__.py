"""Column functions over words, sequences and log probabilities."""
