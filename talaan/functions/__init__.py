"""Part of the talaan engine."""
