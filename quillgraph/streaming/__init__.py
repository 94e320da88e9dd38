"""Part of quillgraph: streaming."""
