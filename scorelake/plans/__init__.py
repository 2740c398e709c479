"""Composed jobs and the queries registered for them."""
