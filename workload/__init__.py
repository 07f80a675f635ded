"""Queries over the driver tables: views shared by both engines, Spark queries and oracle SQL."""
