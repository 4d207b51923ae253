"""Token ids of whole texts with a public byte-level vocabulary, in Arrow batches.

The vocabulary file is read by path, once per Python worker. A tokenizer file in JSON is encoded through
the ranks of its model section: the ids are the ones of its own library, several times faster.
"""

from __future__ import annotations

import base64
import json

import numpy as np
import pyarrow as pa

#: The vocabulary's own rule for cutting text into pieces (fixed value).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_encoders: dict = {}


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str, added: bool):
    """With `added`, the file's added tokens are recognised in a text; otherwise their strings are ordinary text."""
    if (path, added) not in _encoders:
        import tiktoken

        special = _added_tokens(path) if added else {}
        _encoders[path, added] = tiktoken.Encoding(
            "file", pat_str=PIECES, mergeable_ranks=_ranks(path), special_tokens=special
        )
    return _encoders[path, added]


def _added_tokens(path: str) -> dict[str, int]:
    if path.endswith(".tiktoken"):
        return {}
    with open(path, encoding="utf-8") as file:
        found = json.load(file)["added_tokens"]
    if any(t[flag] for t in found for flag in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError(f"{path}: added tokens that look at the text around them are not supported")
    return {t["content"]: t["id"] for t in found}


def _ranks(path: str) -> dict[bytes, int]:
    if path.endswith(".tiktoken"):
        with open(path, "rb") as lines:
            return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    special = {t["content"] for t in content["added_tokens"]}
    # Byte-level vocabularies write each byte as a printable character.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
    return {
        bytes(byte_of[c] for c in token): i for token, i in content["model"]["vocab"].items() if token not in special
    }


def encode_column(column: pa.Array, path: str, added: bool = True):
    """The ids of each text, null being an empty one. As by the library's default, a string of an added token
    is that token; `added=False` reads it as ordinary text, for callers that give the token a meaning."""
    tool = encoder(path, added)
    encode = (lambda text: tool.encode(text, allowed_special="all")) if added else tool.encode_ordinary
    for text in column:
        yield np.array(encode(text.as_py() or ""), np.uint32)
