"""Part of quillgraph: functions."""
