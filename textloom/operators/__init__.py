"""DataFrame operators: counting, estimation, scoring, mixtures, hypotheses, lattices."""
