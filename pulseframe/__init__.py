"""Rare-event analytics over long physiological recordings on Spark."""
