"""Outcomes of requests, as exceptions."""


class Failure(Exception):
    status = "INTERNAL"


class InvalidArgument(Failure):
    status = "INVALID_ARGUMENT"


class NotFound(Failure):
    status = "NOT_FOUND"


class Unavailable(Failure):
    status = "UNAVAILABLE"


class PermissionDenied(Failure):
    status = "PERMISSION_DENIED"


class AlreadyExists(Failure):
    status = "ALREADY_EXISTS"

    def __init__(self, position: int) -> None:
        super().__init__(f"the key was first written at position {position}")
        self.position = position


class FailedPrecondition(Failure):
    status = "FAILED_PRECONDITION"

    def __init__(self, message: str, code: str | None = None, invariant: str | None = None, actual: int | None = None) -> None:
        super().__init__(message)
        self.code, self.invariant, self.actual = code, invariant, actual
