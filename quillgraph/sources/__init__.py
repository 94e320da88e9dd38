"""Part of quillgraph: sources."""
