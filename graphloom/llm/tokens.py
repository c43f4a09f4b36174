"""Token ids of a byte-level BPE vocabulary; the vocabulary file's path is a parameter."""

from __future__ import annotations

import base64
import functools
import os

import numpy as np


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@functools.lru_cache(maxsize=4)
def encoder(path: str):
    """texts -> list of uint32 arrays, for a .json (tokenizers) or .tiktoken file.

    The two files of one vocabulary give the same ids; the second is several times faster. Special
    tokens' strings in a text are ordinary text.
    """
    if path.endswith(".json"):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        return lambda texts: [np.array(e.ids, np.uint32) for e in t.encode_batch(texts, add_special_tokens=False)]
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    t = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda texts: [np.array(t.encode_ordinary(x), np.uint32) for x in texts]
