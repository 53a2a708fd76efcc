"""Failures that have a kind."""

from __future__ import annotations


class BundleError(ValueError):
    """A sealed data set that can't be used: what is wrong, and where."""

    def __init__(self, kind: str, path: str):
        super().__init__(f"Startup failed: {kind} ({path})")
        self.kind, self.path = kind, path
