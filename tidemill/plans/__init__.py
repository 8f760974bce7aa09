"""Query specifications and the plans built from them."""
