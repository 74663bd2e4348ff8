"""Errors of the engine; all have one root."""


class EngineError(Exception):
    """Root of all errors of this library."""


class SourceError(EngineError):
    """Provider data can't be read or has values outside the vocabulary."""


class SegmentationError(EngineError):
    """Nothing to segment."""


class FeatureError(EngineError):
    """No segment to extract features from, or clashing extractors."""


class ModelError(EngineError):
    """A model can't be fitted."""
