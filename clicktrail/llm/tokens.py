"""Token ids of a byte-level vocabulary, as the ``tokenizers`` library gives them."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import tiktoken
from tokenizers import Tokenizer

LONG_TEXT = 1_000_000
"""Texts of more code points go through ``tokenizers`` itself, whose regular expressions need no deep stack."""


@lru_cache(maxsize=4)
def _tokenizer(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def _ranks(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def _special(path: str) -> tuple[str, ...]:
    return tuple(t.content for t in _tokenizer(path).get_added_tokens_decoder().values())


def token_ids(text: str, path: str, ranks_path: str, pattern: str) -> np.ndarray:
    """Ids of the text without added special tokens, as unsigned 32-bit integers.

    ``path`` names the tokenizer's JSON file and decides. ``ranks_path`` holds the same vocabulary as ranks, several
    times faster to apply; texts with a special token's string, and very long ones, are left to the JSON file.
    """
    if len(text) > LONG_TEXT or any(s in text for s in _special(path)):
        return np.array(_tokenizer(path).encode(text, add_special_tokens=False).ids, dtype="<u4")
    return _ranks(ranks_path, pattern).encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)
