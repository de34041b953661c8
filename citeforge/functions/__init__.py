"""Part of the citation analytics engine."""
