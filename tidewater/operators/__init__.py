"""Part of the tidewater engine."""
