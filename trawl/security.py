"""Bearer tokens: only a digest is kept, and comparison takes the same time whatever differs."""

from __future__ import annotations

import hashlib
import hmac

LEAST_CHARACTERS = 32


class TokenError(ValueError):
    """A token that can't be used."""


class Bearer:
    def __init__(self, token: str | None):
        if not token or token != token.strip() or len(token) < LEAST_CHARACTERS:
            raise TokenError(f"a token of at least {LEAST_CHARACTERS} characters without outer blanks is needed")
        self._digest = self._of(token)

    @staticmethod
    def _of(token: str) -> bytes:
        return hashlib.sha256(token.encode("utf-8", "replace")).digest()

    def accepts(self, header: str | None) -> bool:
        """Whether an Authorization header carries the token."""
        scheme, _, given = (header or "").strip().partition(" ")
        given = given.strip()
        return scheme.casefold() == "bearer" and len(given.split()) == 1 and hmac.compare_digest(self._of(given), self._digest)
