"""Column builders."""

from tallyloom.functions import hashing, scores, text

__all__ = ["hashing", "scores", "text"]
