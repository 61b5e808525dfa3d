"""Error taxonomy."""


class ProcessingError(Exception):
    """Root of the library's errors."""


class ModelError(ProcessingError):
    """A language model failed, or its response was refused."""


class ChunkingError(ProcessingError):
    """A document can't be chunked."""


class ValidationError(ProcessingError):
    """A semantic validation can't be made."""
