"""Part of strataforge: functions."""
