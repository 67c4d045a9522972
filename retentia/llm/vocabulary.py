"""Byte-level BPE vocabularies of public tokenizers, read from their files.

The files lie on every machine; a name without a folder is looked up in the
``public_tokenizers`` package there, a full path is taken as it is.
"""

from __future__ import annotations

import base64
import functools
import json
import os

RANK_FILE = "byte_bpe_50k.tiktoken"
JSON_FILE = "byte_bpe_50k.json"


def located(name: str) -> str:
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def _bytes_of_char() -> dict[str, int]:
    """The printable character that stands for each byte in JSON vocabularies:
    printable Latin-1 bytes stand for themselves, the others take the
    characters from U+0100 on in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    moved = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(moved)}


@functools.cache
def ranks(name: str) -> dict[bytes, int]:
    """Token bytes to id, which is also the rank of the merge that makes it."""
    path = located(name)
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        byte = _bytes_of_char()
        special = {t["content"] for t in whole.get("added_tokens", [])}
        return {bytes(byte[c] for c in t): i for t, i in whole["model"]["vocab"].items() if t not in special}
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.cache
def encoding(name: str):
    """A tiktoken encoding of the file's ranks without special tokens."""
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern(), mergeable_ranks=ranks(name), special_tokens={})


@functools.cache
def token_bytes(name: str) -> list[bytes]:
    """The bytes of each id."""
    table = ranks(name)
    out = [b""] * (max(table.values()) + 1)
    for token, i in table.items():
        out[i] = token
    return out
