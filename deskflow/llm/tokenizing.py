"""Byte-level BPE ids of whole texts, as the tokenizers library gives them.

When a file's merges stand in the order of their ids, the vocabulary is also a table of ranks, and tiktoken gives
the library's ids at a fifth of the cost; the tests compare the two. Texts that hold an added token, and every text
under any other file, go to the library itself.

The pattern that cuts texts into pieces ends in white space with a lookahead. Its other alternatives are put into a group,
which changes no match: so all of them are tried at once, as one regular expression, and not one after the other.
"""

from __future__ import annotations

import json
from array import array

import numpy as np

LOOKAHEAD = r"|\s+(?!\S)|\s+"
_BY_PATH: dict[str, ByteEncoder] = {}


def byte_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[int, str]:
    """The letter that byte-level tokenizers write for each byte: itself if it is visible, else the next from 256."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class ByteEncoder:
    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        top = max(self.library.get_vocab(with_added_tokens=True).values(), default=0)
        self.dtype = np.dtype("<u2" if top < 1 << 16 else "<u4")
        self.size = top + 1
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        with open(path, encoding="utf-8") as f:
            plan = json.load(f)
        self.added = [t["content"] for t in plan["added_tokens"]]
        self.ranks = self._ranks(plan)

    @classmethod
    def at(cls, path: str) -> ByteEncoder:
        if path not in _BY_PATH:
            _BY_PATH[path] = cls(path)
        return _BY_PATH[path]

    def _ranks(self, plan: dict):
        """A tiktoken encoder of the same ids, or None if the file's rules are not those it has."""
        model, before = plan["model"], plan["pre_tokenizer"] or {}
        merged = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" "))) for m in model.get("merges", [])]
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "end_of_word_suffix", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        if not (plain and plan["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")):
            return None
        if None in merged or merged != sorted(merged) or len(set(merged)) != len(merged) or len(merged) + 256 != len(model["vocab"]):
            return None
        import public_tokenizers
        import tiktoken

        back = {c: b for b, c in byte_letters().items()}
        ranks = {bytes(back[c] for c in token): i for token, i in model["vocab"].items()}
        head = public_tokenizers.PATTERN.removesuffix(LOOKAHEAD)
        pattern = public_tokenizers.PATTERN.replace(head, f"(?:{head})", 1)
        # without any special token, encode_to_numpy would stop at every character to look for one
        return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={"<|none|>": self.size})

    def library_ids(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian bytes of ``dtype``."""
        if self.ranks is None:
            return self.library_ids(texts)
        special = [i for i, t in enumerate(texts) if any(a in t for a in self.added)]
        encode, dtype = self.ranks.encode_to_numpy, self.dtype
        out = [encode(t, disallowed_special=()).astype(dtype).tobytes() for t in texts]
        for i, ids in zip(special, self.library_ids([texts[i] for i in special]), strict=True):
            out[i] = ids
        return out
