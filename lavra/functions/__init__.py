"""Part of lavra; see README.md."""
