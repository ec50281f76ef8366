"""Procurement-integrity analytics and corpus preparation as Spark jobs."""
