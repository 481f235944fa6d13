"""Errors that users see; the command line prints `error: ...` and exits with 1."""


class ArtifactError(Exception):
    """Any failure with a message for the user."""


class InputError(ArtifactError):
    """Paths, containers, selectors and options."""


class DexError(ArtifactError):
    """A binary that can't be decoded."""


class MappingError(ArtifactError):
    """A mapping that can't be read, or has nothing usable."""


class AuditFailed(ArtifactError):
    """More unresolved references than allowed; reports have been written."""
