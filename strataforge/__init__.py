"""Lakehouse analytics operators written as lazy Spark DataFrame functions."""
