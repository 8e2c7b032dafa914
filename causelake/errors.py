"""Typed refusals: what is not justified raises instead of being approximated."""


class CausalError(Exception):
    """Base of all errors of the engine."""


class DataError(CausalError):
    """The rows cannot be used as asked."""


class GraphError(CausalError):
    """The graph is malformed or the wrong class."""


class NotIdentified(CausalError):
    """The query is not identified; ``reason`` names the obstacle."""

    def __init__(self, reason: str):
        super().__init__(reason)
        self.reason = reason


class EstimationError(CausalError):
    """An estimator's precondition fails."""


class Unsupported(CausalError):
    """The combination is outside the support matrix."""


class ReviewRequired(CausalError):
    """A discovered structure has pending edges that a person must accept or orient."""

    def __init__(self, pending):
        super().__init__(f"{len(pending)} edges await review")
        self.pending = tuple(pending)
