"""Part of tidemill."""
