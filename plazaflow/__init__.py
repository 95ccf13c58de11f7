"""plazaflow: city-scale analytics as ordinary Spark DataFrame transformations."""
