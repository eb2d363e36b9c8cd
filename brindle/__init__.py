"""Brindle: a Spark-first analytics engine (DataFrame / SQL / Catalyst)."""
