"""Part of strataforge: operators."""
