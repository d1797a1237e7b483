"""Errors of the engine."""


class PulseError(Exception):
    """Base of the engine's errors; ``reason`` is a short machine-readable word."""

    def __init__(self, message: str, reason: str = ""):
        super().__init__(message)
        self.reason = reason


class DataLoadError(PulseError):
    def __init__(self, reason: str):
        super().__init__(f"stored data can't be loaded: {reason}", reason)


class UnsupportedMetricError(PulseError):
    def __init__(self, metric_type: str):
        super().__init__(f"metrics of type {metric_type} can't be exported this way; name one of its fields", "unsupported")
        self.metric_type = metric_type


class BinaryFormatError(PulseError):
    """reason is corrupt or invalid_format."""

    def __init__(self, reason: str):
        super().__init__(f"not a metrics export: {reason}", reason)


class ExportFileError(PulseError):
    def __init__(self, reason: str, file: str, operation: str):
        super().__init__(f"{operation} of {file} failed: {reason}", reason)
        self.file, self.operation = file, operation


class PersistenceError(PulseError):
    def __init__(self, path: str, reason: str):
        super().__init__(f"{path} can't hold an instance: {reason}", "persistence")
        self.path = path
