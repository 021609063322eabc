"""pulsegrid: emergency-response analytics expressed as Spark jobs."""
