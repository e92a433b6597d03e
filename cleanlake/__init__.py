"""cleanlake: find and remove data that nothing needs any more, on Spark."""

from cleanlake.policy import FileFilter, RetentionPolicy

__all__ = ["FileFilter", "RetentionPolicy"]
