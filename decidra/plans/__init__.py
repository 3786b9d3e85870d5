"""Queries over the driver's tables; importing `catalog` registers all of them."""
