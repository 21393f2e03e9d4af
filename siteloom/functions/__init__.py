"""Part of siteloom."""
