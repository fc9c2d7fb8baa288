"""Spark engine for translation-log analytics and document segmentation, classification and segment translation."""
