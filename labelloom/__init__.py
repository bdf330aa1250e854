"""Content-labelling and quality-assurance analytics as lazy Spark plans."""
