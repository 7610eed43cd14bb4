"""Stay-centred analytics for irregular clinical measurements, written for Spark."""
