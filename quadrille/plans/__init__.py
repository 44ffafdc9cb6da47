"""Query text, algebra and rewrites."""
