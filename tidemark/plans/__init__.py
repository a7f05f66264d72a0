"""Part of tidemark: plans."""
