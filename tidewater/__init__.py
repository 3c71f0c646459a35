"""tidewater: point-in-time analytics, governance checks and corpus operators on Spark."""
