"""Errors that callers can tell apart."""


class HushError(Exception):
    """Base of all."""


class IndexNotFound(HushError):
    def __init__(self, name: str) -> None:
        super().__init__(f"there is no index {name!r}")


class IndexExists(HushError):
    def __init__(self, name: str) -> None:
        super().__init__(f"index {name!r} is there already")


class EntryNotFound(HushError):
    def __init__(self, index: str, entry: str) -> None:
        super().__init__(f"index {index!r} has no entry {entry!r}")


class InvalidArgument(HushError):
    def __init__(self, what: str) -> None:
        super().__init__(f"bad argument: {what}")


class PolicyDenied(HushError):
    def __init__(self, action: str, resource: str, policy: str) -> None:
        super().__init__(f"policy {policy!r} forbids {action} on {resource}")


class AccessDenied(HushError):
    pass


class StoreError(HushError):
    def __init__(self, what: str) -> None:
        super().__init__(f"storage: {what}")


class InternalError(HushError):
    def __init__(self, what: str) -> None:
        super().__init__(f"internal: {what}")
