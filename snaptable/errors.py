"""What can go wrong, by name."""


class SnaptableError(Exception):
    """Base of all errors raised here."""


class NotFound(SnaptableError):
    """No snapshot, collection, export or row under that name."""


class KeyProblem(SnaptableError):
    """A key is null, repeated, already there or matches nothing."""


class MissingObjects(SnaptableError):
    """Stored rows that a snapshot refers to are gone."""


class Conflict(SnaptableError):
    """Another writer has committed since; nothing was changed."""


class Damaged(SnaptableError):
    """A copy is not what was written."""


class BadRequest(SnaptableError, ValueError):
    """An argument that has no meaning."""
