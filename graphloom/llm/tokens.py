"""Encoding with a public tokenizer file, inside Python workers.

The driver reads the file once and ships its bytes, so executors need no path.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache
from typing import NamedTuple

import numpy as np

#: Characters other than those for which tests compare both encoders below. White space that pattern engines class differently is among them.
_OTHER = re.compile("[^\t\n\r -~¡-ɏ‐-‧€]")


class TokenizerSpec(NamedTuple):
    """A tokenizers .json file by content."""

    digest: str
    content: bytes

    @staticmethod
    def from_file(path: str) -> "TokenizerSpec":
        with open(path, "rb") as f:
            content = f.read()
        return TokenizerSpec(hashlib.sha256(content).hexdigest(), content)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level BPE files: printable Latin-1 stands for itself, the rest is moved above 255."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """Ids as the tokenizers library gives them without added special tokens.

    Where the file is plain byte-level BPE whose ids are its merge ranks,
    texts of well-known characters take a faster encoder of the same
    vocabulary; every other text goes through the library itself.
    """

    def __init__(self, spec: TokenizerSpec):
        self._content = spec.content
        self._slow = None
        self._fast = self._special = None
        self._build_fast()

    def _build_fast(self) -> None:
        import public_tokenizers
        import tiktoken

        conf = json.loads(self._content)
        model, pre = conf["model"], conf.get("pre_tokenizer") or {}
        if model.get("type", "BPE") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or conf.get("normalizer") or not pre.get("use_regex", True):
            return
        added = conf.get("added_tokens") or []
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            return
        special = {t["content"]: t["id"] for t in added}
        alphabet = _byte_alphabet()
        ranks = {bytes(alphabet[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [bytes(alphabet[c] for c in a + b) for a, b in merges]
        if [ranks[m] for m in made] != sorted(ranks[m] for m in made):
            return  # ids are not in the order of the merges
        self._fast = tiktoken.Encoding("shipped", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self._special = set(special)

    def _library(self):
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_str(self._content.decode())
        return self._slow

    def encode(self, text: str) -> np.ndarray:
        if self._fast is not None and not _OTHER.search(text):
            return self._fast.encode_to_numpy(text, allowed_special=self._special)
        return np.asarray(self._library().encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def count(self, text: str) -> int:
        return len(self.encode(text))


@lru_cache(maxsize=2)
def _cached(digest: str, content: bytes) -> Encoder:
    return Encoder(TokenizerSpec(digest, content))


def encoder(spec: TokenizerSpec) -> Encoder:
    """One encoder per worker process, whatever the number of tasks."""
    return _cached(spec.digest, spec.content)
