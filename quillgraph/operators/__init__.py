"""Part of quillgraph: operators."""
