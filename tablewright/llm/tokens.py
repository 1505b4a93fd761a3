"""Token ids of whole texts from a byte-level BPE vocabulary file of the `tokenizers` library.

`tiktoken` merges the pair that makes the token of lowest rank and is several times faster; the library merges only the pairs
listed in the file. Both give the same ids if ranks follow the list and every token's own bytes encode to that one token: a
pair that only `tiktoken` merges would be a token that the library cannot reach from its own bytes. `Encoder` checks both
conditions when it loads a file and uses the library alone where they do not hold. Texts with characters outside the checked
range, or with a special token's string, go through the library in any case.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np

#: The pre-tokenizer's pattern of byte-level BPE vocabularies (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Where all regular expression libraries surely agree about letters, numbers and white space.
PLAIN = r"[\t\n\r\x20-\x7e¡-ɏΑ-Ρα-ωА-я‐-‧]*"


def _byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves and the others, in order, as the characters from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(vocabulary)
        self._special = [t.content for t in self._library.get_added_tokens_decoder().values()]
        self._plain = re.compile(PLAIN).fullmatch
        self._fast = self._ranked(vocabulary)

    def _ranked(self, vocabulary: str):
        """A tiktoken encoding of equal results, or None."""
        import tiktoken

        with open(vocabulary, encoding="utf-8") as f:
            file = json.load(f)
        model, kind = file["model"], file["pre_tokenizer"] or {}
        vocab = {t: i for t, i in model["vocab"].items() if t not in self._special}
        merged = [vocab.get("".join(m) if isinstance(m, list) else m.replace(" ", "", 1), -1) for m in model["merges"]]
        steady = kind.get("type") == "ByteLevel" and kind.get("use_regex") and not kind.get("add_prefix_space") and file["normalizer"] is None
        if not steady or any(a >= b for a, b in zip([-1, *merged], merged)) or any(len(self._library.model.tokenize(t)) != 1 for t in vocab):
            return None
        letters = _byte_letters()
        ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items()}
        return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if self._fast and self._plain(text) and not any(s in text for s in self._special):
            return self._fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
        return np.array(self._library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@lru_cache(maxsize=2)
def encoder(vocabulary: str) -> Encoder:
    """One encoder for all tasks of a worker process."""
    return Encoder(vocabulary)
