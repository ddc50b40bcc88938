"""A byte-level BPE tokenizer read from its JSON file, for use inside tasks."""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import tiktoken
from tokenizers import Tokenizer


def _byte_of_character() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class ByteTokens:
    """Encodes as the ``tokenizers`` library does with ``add_special_tokens=False``.

    Where the ids of the merges rise in the order of the merges, ranks alone decide, and ``tiktoken`` gives the same ids
    in a fifth of the time. Any other file, and texts that hold an added token's string, go to ``tokenizers`` itself.
    """

    def __init__(self, spec: str, pattern: str):
        read = json.loads(spec)
        model, byte_of = read["model"], _byte_of_character()
        entry = {i: bytes(byte_of[c] for c in token) for token, i in model["vocab"].items() if all(c in byte_of for c in token)}
        added = {t["id"]: t["content"] for t in read.get("added_tokens") or ()}
        ranks = {b: i for i, b in entry.items() if i not in added}
        merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        pre = read.get("pre_tokenizer") or {}
        by_rank = all(a < b for a, b in zip(merged, merged[1:], strict=False)) and min(merged, default=256) >= 256
        by_rank &= read.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        by_rank &= not model.get("dropout") and not model.get("ignore_merges") and all(bytes([b]) in ranks for b in range(256))
        self.bytes_of = [entry.get(i, added.get(i, "").encode()) for i in range(max([*entry, *added]) + 1)]
        self.added = list(added.values())
        self._ranked = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}) if by_rank else None
        self._spec, self._whole = spec, None

    def encode(self, text: str, plain: bool = False) -> np.ndarray:
        """Ids of a text; with ``plain`` the strings of added tokens are ordinary text."""
        if self._ranked is not None and (plain or not any(t in text for t in self.added)):
            return self._ranked.encode_to_numpy(text, disallowed_special=())
        if self._whole is None:
            self._whole = Tokenizer.from_str(self._spec)
        self._whole.encode_special_tokens = plain
        return np.array(self._whole.encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(maxsize=4)
def byte_tokens(spec: str, pattern: str) -> ByteTokens:
    """One instance for all tasks of a Python worker."""
    return ByteTokens(spec, pattern)
