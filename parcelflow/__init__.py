"""Cleaning and analysis of property listings as Spark DataFrame operators."""
