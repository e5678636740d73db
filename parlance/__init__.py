"""parlance: dialogue and text analytics as Spark DataFrame transformations."""
