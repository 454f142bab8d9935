"""From syntax tree to DataFrame."""
