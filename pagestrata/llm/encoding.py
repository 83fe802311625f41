"""Encoders of public vocabulary files for batches of texts inside tasks.

A rank file is read by tiktoken. Its pattern gives up on very long stretches without a
break, so texts over LONG_TEXT characters are encoded from the JSON file of the same
vocabulary, which lies beside the rank file and gives the same ids (tests compare both).
"""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Callable

#: Characters from which a text isn't given to tiktoken.
LONG_TEXT = 100_000


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=2)
def json_encoder(path: str, special: bool) -> Callable[[list[str]], list]:
    """special: whether strings of special tokens become those tokens; else they are plain text."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    read = Tokenizer.from_file(path)
    read.encode_special_tokens = not special
    return lambda texts: [x.ids for x in read.encode_batch_fast(texts, add_special_tokens=False)]


@functools.lru_cache(maxsize=2)
def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@functools.lru_cache(maxsize=2)
def byte_tokens(path: str) -> list[bytes]:
    """The bytes of each id of a rank file."""
    return sorted(ranks_of(path), key=ranks_of(path).get)


@functools.lru_cache(maxsize=4)
def encoder(path: str, special: bool = False) -> Callable[[list[str]], list]:
    """Ids of each of many texts, from a rank file or a JSON file."""
    if path.endswith(".json"):
        return json_encoder(path, special)
    import public_tokenizers
    import tiktoken

    names = {"<|endoftext|>": 50256}
    bpe = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks_of(path), special_tokens=names)
    allowed = set(names) if special else set()
    beside = f"{os.path.splitext(path)[0]}.json"

    def encode(texts: list[str]) -> list:
        return [json_encoder(beside, special)([x])[0] if len(x) > LONG_TEXT else bpe.encode(x, allowed_special=allowed, disallowed_special=()) for x in texts]

    return encode
