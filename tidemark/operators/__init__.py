"""Part of tidemark: operators."""
