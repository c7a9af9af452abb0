"""Access rules, policy and audit hooks."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from hushdex.errors import AccessDenied, InternalError, PolicyDenied

READ, WRITE, ADMIN = "read", "write", "admin"
#: Namespace of an index, as grants name it.
NAMESPACE = "hushdex.{index}.*"


@dataclass(frozen=True)
class Grant:
    namespace: str
    scopes: tuple[str, ...]

    def covers(self, namespace: str, scope: str) -> bool:
        stem = self.namespace.removesuffix("*")
        fits = namespace == self.namespace or self.namespace.endswith("*") and namespace.startswith(stem)
        return fits and scope in self.scopes


@dataclass(frozen=True)
class AuthContext:
    """Who calls. ``platform`` callers may do everything."""

    actor: str
    tenant: str = "default"
    platform: bool = False
    grants: tuple[Grant, ...] = ()


@dataclass(frozen=True)
class Need:
    """What a command asks of its caller: nothing, admin rights, or a scope of an index."""

    scope: str | None = None
    index: str | None = None

    def check(self, context: AuthContext | None) -> None:
        """No context means that access rules are switched off."""
        if self.scope is None or context is None or context.platform:
            return
        if self.scope == ADMIN:
            if not any(ADMIN in g.scopes for g in context.grants):
                raise AccessDenied("access denied: admin rights needed")
            return
        namespace = NAMESPACE.format(index=self.index)
        if not any(g.covers(namespace, self.scope) for g in context.grants):
            raise AccessDenied(f"access denied: {self.scope} on {namespace}")


@dataclass(frozen=True)
class Capability:
    """A hook that is switched on, off for tests, or off for a stated reason."""

    hook: Callable | None = None
    reason: str = ""

    @classmethod
    def enabled(cls, hook: Callable) -> Capability:
        return cls(hook)

    @classmethod
    def for_tests(cls) -> Capability:
        return cls(None, "disabled for tests")

    @classmethod
    def disabled(cls, reason: str) -> Capability:
        if not reason:
            raise ValueError("a reason is needed")
        return cls(None, reason)

    @property
    def is_enabled(self) -> bool:
        return self.hook is not None


@dataclass(frozen=True)
class PolicyRequest:
    principal: str
    resource: str
    action: str
    resource_type: str = "index"


@dataclass(frozen=True)
class Decision:
    allow: bool
    policy: str = ""


@dataclass(frozen=True)
class AuditEvent:
    operation: str
    resource: str
    actor: str
    duration_ms: int
    result: str = "ok"
    resource_type: str = "index"


@dataclass
class Guard:
    """Policy before an action, audit after it; a failing audit fails the call."""

    policy: Capability = field(default_factory=Capability.for_tests)
    audit: Capability = field(default_factory=Capability.for_tests)

    def require(self, policy: bool, audit: bool) -> None:
        for name, wanted, have in (("policy", policy, self.policy), ("audit", audit, self.audit)):
            if wanted and not have.is_enabled:
                raise InternalError(f"{name} is required but {have.reason}")

    def allow(self, resource: str, action: str, actor: str | None) -> None:
        if self.policy.hook is None:
            return
        try:
            decision = self.policy.hook(PolicyRequest(actor or "", resource, action))
        except Exception as e:
            raise InternalError(f"policy evaluation: {e}") from e
        if not decision.allow:
            raise PolicyDenied(action, resource, decision.policy)

    @contextmanager
    def audited(self, operation: str, resource: str, actor: str | None) -> Iterator[None]:
        """Record the action once it is done. What was written stays written."""
        start = time.monotonic()
        yield
        if self.audit.hook is None:
            return
        event = AuditEvent(operation, resource, actor or "anonymous", int((time.monotonic() - start) * 1000))
        try:
            self.audit.hook(event)
        except Exception as e:
            raise InternalError(f"audit failed: {e}") from e
