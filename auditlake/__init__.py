"""Compliance-scan analytics and training-corpus preparation as ordinary Spark jobs."""
