"""Token ids of a public byte-level BPE, read from its tokenizer file.

The file's vocabulary is given to tiktoken, which makes the same ids several times faster than the file's own library (tests
compare the two). Strings of the file's special tokens become those tokens, as in the file's own library. Texts whose runs of
one kind of character are too long for tiktoken's pattern are encoded by the file's own library.
"""

from __future__ import annotations

import base64
import json
from functools import lru_cache

import numpy as np

#: The split of the public byte-level BPE files, as their own package states it.
DEFAULT_FILE = "byte_bpe_50k.json"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_FILE)


def _printable_bytes() -> dict[str, int]:
    """The byte of each character by which a byte-level vocabulary writes it: printable ones stand for themselves."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=2)
def encoder(path: str):
    """The tiktoken encoding of a byte-level BPE tokenizer file; one per Python worker."""
    import public_tokenizers
    import tiktoken

    if path.endswith(".tiktoken"):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
        special: dict[str, int] = {}
    else:
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        special = {t["content"]: t["id"] for t in described.get("added_tokens", [])}
        byte_of = _printable_bytes()
        ranks = {
            bytes(byte_of[c] for c in word): number for word, number in described["model"]["vocab"].items() if word not in special
        }
    return tiktoken.Encoding("byte-bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


@lru_cache(maxsize=2)
def own_encoder(path: str):
    """The file's own library, for texts that the faster one cannot split; one per Python worker."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def ids_of(text: str, path: str) -> np.ndarray:
    """The ids of one whole text as unsigned 32-bit numbers, whatever its length."""
    known = encoder(path)
    try:
        if any(s in text for s in known.special_tokens_set):
            return np.array(known.encode(text, allowed_special="all"), dtype="<u4")
        return known.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)
    except ValueError:
        if not path.endswith(".json"):
            raise
        return _own_ids(text, path)


def _own_ids(text: str, path: str) -> np.ndarray:
    return np.array(own_encoder(path).encode(text, add_special_tokens=False).ids, dtype="<u4")
