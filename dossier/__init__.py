"""Announcement and document analytics on Spark."""
