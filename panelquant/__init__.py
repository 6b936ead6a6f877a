"""Investment-research analytics as Spark DataFrame operators on long tables."""
