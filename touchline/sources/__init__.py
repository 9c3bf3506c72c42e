"""Readers and writers; every path is opened by Spark."""
