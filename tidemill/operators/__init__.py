"""Query operators over points tables."""
