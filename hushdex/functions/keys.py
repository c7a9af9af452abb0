"""Index keys. Nothing here runs on executors."""

from __future__ import annotations

import hashlib
import hmac
import secrets

KEY_BYTES = 32
_BLOCK = 64


def generate() -> bytes:
    return secrets.token_bytes(KEY_BYTES)


def from_bytes(data: bytes) -> bytes:
    if len(data) != KEY_BYTES:
        raise ValueError(f"a key has {KEY_BYTES} bytes, not {len(data)}")
    return bytes(data)


def derive_root(secret: bytes) -> bytes:
    """First step of HKDF-SHA256, with a salt of zero bytes."""
    return hmac.digest(bytes(KEY_BYTES), secret, "sha256")


def derive(secret: bytes, info: bytes) -> bytes:
    """HKDF-SHA256 with a salt of zero bytes and one output block."""
    return hmac.digest(derive_root(secret), info + b"\x01", "sha256")


def pads(key: bytes) -> tuple[bytes, bytes]:
    """Inner and outer HMAC blocks."""
    block = from_bytes(key).ljust(_BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)


def blind_token(key: bytes, token: str) -> str:
    return hmac.new(key, token.encode(), hashlib.sha256).hexdigest()
