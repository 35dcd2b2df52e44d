"""Point-in-time (entity, day) panel analytics as Spark DataFrame operators."""
