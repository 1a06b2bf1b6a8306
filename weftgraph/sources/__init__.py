"""sources of weftgraph."""
