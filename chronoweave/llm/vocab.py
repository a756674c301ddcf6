"""Public tokenizer files: path, ranks and encoder; the path is a parameter throughout."""

from __future__ import annotations

import base64
import os

#: The folder of the installed vocabulary files and the pre-token pattern of the byte-level vocabularies.
DEFAULT_DIR = "/opt/tokenizers"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BYTE_BPE = "byte_bpe_50k.tiktoken"

_made: dict[int, object] = {}


def vocabulary(path: str | None = None) -> bytes:
    """The content of a rank file (well under 1 MB, so it may be sent to every executor)."""
    with open(path or os.path.join(DEFAULT_DIR, BYTE_BPE), "rb") as f:
        return f.read()


def ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}


def encoder(content: bytes):
    """The encoder of a rank file's content, made once per Python worker."""
    key = hash(content)
    if key not in _made:
        import tiktoken

        _made[key] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks(content), special_tokens={})
    return _made[key]
