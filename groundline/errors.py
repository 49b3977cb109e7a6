"""Errors by the part that raises them."""


class SourceValidationError(ValueError):
    """A source row breaks the allowlist's rules."""


class FetchError(RuntimeError):
    """A page could not be fetched."""


class StructureError(ValueError):
    """A page has no content that can be read."""


class ChunkingError(ValueError):
    """Chunking was asked for something that it cannot do."""


class ChunkInvariantError(ChunkingError):
    """Chunks break an invariant."""


class EmbeddingError(RuntimeError):
    """A text cannot be embedded."""


class ModelMismatchError(EmbeddingError):
    """The index was built by another model."""


class IndexBuildError(RuntimeError):
    """The index cannot be built."""


class IndexVerificationError(IndexBuildError):
    """The index differs from what was put in."""


class RetrievalError(RuntimeError):
    """A search cannot be run."""


class MissingCollectionError(RetrievalError):
    """There is no index."""


IndexMissingError = MissingCollectionError


class EmptyCollectionError(RetrievalError):
    """The index has no rows."""


class GenerationError(RuntimeError):
    """A generator failed; a transient failure may pass, after so many seconds if it says so."""

    def __init__(self, said: str = "", transient: bool = True, wait_s: float | None = None) -> None:
        super().__init__(said)
        self.transient, self.wait_s = transient, wait_s


class GeneratorNotConfiguredError(GenerationError):
    """A generator lacks its key or address."""
