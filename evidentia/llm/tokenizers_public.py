"""Public byte-level vocabularies, loaded once per Python worker from a path that is a parameter."""

from __future__ import annotations

import base64
import functools
import json

import tiktoken

#: The split pattern of the rank files; a fixed value of the public vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@functools.lru_cache(4)
def added_tokens(path: str) -> dict[str, int]:
    """The added tokens of a JSON form; only those that match as they stand are known here."""
    with open(path, encoding="utf-8") as form:
        tokens = json.load(form)["added_tokens"]
    if odd := [t["content"] for t in tokens if t["single_word"] or t["lstrip"] or t["rstrip"]]:
        raise ValueError(f"added tokens with rules of their own: {odd}")
    return {t["content"]: t["id"] for t in tokens}


@functools.lru_cache(4)
def encoder(path: str, json_form: str | None = None) -> tiktoken.Encoding:
    """The rank form at path; with a JSON form, texts are split at its added tokens by `encode(text, allowed_special="all")`."""
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks(path), special_tokens=added_tokens(json_form) if json_form else {})
