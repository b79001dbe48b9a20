"""Typed decision datasets on Spark: build, check, mix, augment and score."""
