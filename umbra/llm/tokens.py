"""Token ids of whole texts, by a public tokenizer file."""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np

#: Fixed value: the split of byte-level BPE before merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_of() -> dict[str, int]:
    """Byte-level BPE writes each byte as a printable character."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Ids:
    """Ids of a text as an array, the same as
    ``Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids``.

    A byte-level BPE file is read into a faster public encoder with the same
    ids; other files, and texts that hold a special token's string, go through
    the tokenizers library itself. ``ordinary``: such strings are ordinary text.
    """

    def __init__(self, path: str, ordinary: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path, self.hf, self.plain, self.ordinary = path, None, None, ordinary
        self.specials = [x["content"] for x in spec.get("added_tokens") or []]
        split, model = spec.get("pre_tokenizer") or {}, spec["model"]
        ids = [*model["vocab"].values(), *(x["id"] for x in spec.get("added_tokens") or [])]
        self.dtype = np.dtype("<u2" if max(ids) < 1 << 16 else "<u4")
        if model.get("type") in ("BPE", None) and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True) and not spec.get("normalizer") and not model.get("continuing_subword_prefix"):
            import tiktoken

            byte_of = _byte_of()
            ranks = {bytes(byte_of[c] for c in t): i for t, i in model["vocab"].items() if t not in self.specials}
            self.plain = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __call__(self, text: str | None) -> np.ndarray:
        """The ids of one text; null and empty have none."""
        if not text:
            return np.zeros(0, self.dtype)
        if self.plain is not None and (self.ordinary or not any(s in text for s in self.specials)):
            return np.array(self.plain(text), self.dtype)
        if self.hf is None:
            from tokenizers import Tokenizer

            self.hf = Tokenizer.from_file(self.path)
            self.hf.encode_special_tokens = self.ordinary
        return np.array(self.hf.encode(text, add_special_tokens=False).ids, self.dtype)


@lru_cache(maxsize=2)
def ids_of(path: str, ordinary: bool = False) -> Ids:
    """One encoder for all tasks of a process."""
    return Ids(path, ordinary)
