"""Sequential kernels over one sentence, hypothesis list or lattice; no Spark imports."""
