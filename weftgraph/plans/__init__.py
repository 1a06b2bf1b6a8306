"""plans of weftgraph."""
