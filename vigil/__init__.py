"""Vigil: scene, alert and dataset analytics on Spark DataFrames."""
