"""Change-risk analysis of source code on Spark."""
