"""Errors with stable codes."""


class LatentError(ValueError):
    """Every error of the library; `code` tells which."""

    code = "internal"

    def __init__(self, message: str, code: str | None = None, **details):
        super().__init__(message)
        self.code = code or self.code
        self.details = details


class DimensionMismatch(LatentError):
    code = "dimension_mismatch"


class KExceedsMax(LatentError):
    code = "k_exceeds_max"


class NonFiniteInput(LatentError):
    code = "non_finite_input"


class ConvergenceFailure(LatentError):
    """Reserved: nothing raises it."""

    code = "convergence_failure"


class InvalidArgument(LatentError):
    code = "invalid_argument"


class InvalidArgs(LatentError):
    code = "invalid_args"


class InvalidInput(LatentError):
    code = "invalid_input"


class ShapeMismatch(LatentError):
    code = "shape_mismatch"


class InvalidWeights(LatentError):
    """`reason` is one of length_mismatch, negative, all_zero, insufficient_effective_n."""

    code = "invalid_weights"

    def __init__(self, message: str, reason: str):
        super().__init__(message, reason=reason)
        self.reason = reason


class RotationMethodNotImplemented(LatentError):
    code = "rotation_method_not_implemented"


class AlreadyRotated(LatentError):
    code = "already_rotated"


class ResamplingDegenerate(LatentError):
    code = "resampling_degenerate"


class ResampleFailureRateExceeded(LatentError):
    code = "resample_failure_rate_exceeded"


class PermNullDegenerate(LatentError):
    code = "perm_null_degenerate"


class SequenceNoRejection(LatentError):
    code = "sequence_no_rejection"
