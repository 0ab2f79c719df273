"""Text cleaning and redaction as Spark columns and plans."""

from .config import CleanConfig
from .plans.pipeline import TextCleaner, TextCleanerTransformer, clean

__all__ = ["CleanConfig", "TextCleaner", "TextCleanerTransformer", "clean"]
