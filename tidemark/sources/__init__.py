"""Part of tidemark: sources."""
