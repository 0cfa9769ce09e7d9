"""Terravane: survey point clouds and the tables around them, as lazy Spark DataFrames."""
