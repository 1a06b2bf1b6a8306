"""operators of weftgraph."""
