"""Tidewarden: preparing and auditing content-moderation data with Spark DataFrames."""
