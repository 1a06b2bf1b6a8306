"""streaming of weftgraph."""
