"""Where the public tokenizers' vocabulary files are."""

from __future__ import annotations

import public_tokenizers


def vocabulary(name: str) -> str:
    """The path of a vocabulary file, the same on the driver and on executors."""
    return public_tokenizers.path(name)
