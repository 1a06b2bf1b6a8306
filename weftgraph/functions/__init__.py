"""functions of weftgraph."""
