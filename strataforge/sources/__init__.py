"""Part of strataforge: sources."""
