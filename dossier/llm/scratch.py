"""Intermediate tables in the folder that a cluster's executors share."""

from dossier.store import dropped, fresh_path, shared_dir, stored

__all__ = ["dropped", "fresh_path", "shared_dir", "stored"]
