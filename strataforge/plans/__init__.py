"""Part of strataforge: plans."""
