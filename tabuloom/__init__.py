"""Survey tabulation as Spark DataFrame transformations."""
