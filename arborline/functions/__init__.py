"""Part of arborline; see README.md."""
