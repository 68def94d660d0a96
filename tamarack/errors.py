"""Errors raised while a request or a schema is checked, before any job runs."""


class RequestError(ValueError):
    """A request that can't be answered as it stands."""


class SchemaError(ValueError):
    """A schema or a document that breaks its rules."""


class AggregationError(RequestError):
    """kind: `unknown_field`, `wrong_type` or `invalid_config`."""

    def __init__(self, kind: str, message: str) -> None:
        super().__init__(message)
        self.kind = kind
