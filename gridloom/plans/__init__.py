"""Views: the declarative pipeline, its canonical order, and its export as code."""
