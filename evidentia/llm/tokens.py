"""Byte-level BPE ids on executors. Vocabulary files are read by path and never copied or trained."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable

#: A text with a longer run of non-space characters goes to the slower of the two equal encoders.
LONG_RUN = 10_000
_LOADED: dict[str, Callable[[list[str]], list[list[int]]]] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str | None = None) -> Callable[[list[str]], list[list[int]]]:
    """texts -> ids, without special tokens; their strings in a text are ordinary text.

    ``path`` is a ``tokenizers`` file. Where a ``.tiktoken`` file of the same name stands beside it,
    it holds the same vocabulary as ranks and gives the same ids about four times as fast; texts with
    very long runs of non-space characters use ``tokenizers`` itself.
    """
    path = path or default_path()
    if path not in _LOADED:
        _LOADED[path] = _load(path)
    return _LOADED[path]


def _load(path: str) -> Callable[[list[str]], list[list[int]]]:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(path)
    exact.encode_special_tokens = True
    slow = lambda texts: [e.ids for e in exact.encode_batch(texts, add_special_tokens=False)]
    ranks_file = path.removesuffix(".json") + ".tiktoken"
    if not path.endswith(".json") or not os.path.exists(ranks_file):
        return slow
    import public_tokenizers
    import tiktoken

    with open(ranks_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    long_run = re.compile(r"\S{%d}" % LONG_RUN)

    def encode(texts: list[str]) -> list[list[int]]:
        return [slow([t])[0] if len(t) >= LONG_RUN and long_run.search(t) else fast.encode_ordinary(t) for t in texts]

    return encode
