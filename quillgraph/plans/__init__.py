"""Part of quillgraph: plans."""
