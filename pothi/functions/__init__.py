"""Part of the pothi document-analytics engine."""
