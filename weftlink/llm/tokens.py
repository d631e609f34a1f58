"""Encoding with a public byte-level BPE vocabulary file.

The ids are those of the ``tokenizers`` library on the file. A second encoder reads the
same vocabulary and is about five times faster. It merges by id, which gives equal ids only
where the file's merges stand in the order of the ids they make and texts are split in
the plain byte-level way; ``by_rank`` looks at the file for that, and any other file is left to the
library. So is a text that spells out an added token, which the library maps to that token's id.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np

#: Split pattern of this family of byte-level vocabularies.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabulary files."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


def by_rank(spec: dict) -> bool:
    """Whether merging by id gives the ids that the file's own merges give."""
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type", "BPE") != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback")):
        return False
    if spec.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        return False
    vocab, letters = model["vocab"], _byte_letters()
    made = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    whole = len(made) + len(letters) >= len([w for w in vocab if set(w) <= set(letters)]) and all(c in vocab for c in letters)
    return whole and None not in made and all(a < b for a, b in zip(made, made[1:], strict=False)) and (not made or max(vocab[c] for c in letters) < made[0])


class Encoder:
    """ids of texts by the vocabulary file at ``path``."""

    def __init__(self, path: str):
        import tiktoken

        self.path, self._whole = path, None
        spec = json.load(open(path, encoding="utf-8"))
        letters = _byte_letters()
        self.added = [t["content"] for t in spec.get("added_tokens", ())]
        self.fast = None
        if by_rank(spec):
            ranks = {bytes(letters[c] for c in w): i for w, i in spec["model"]["vocab"].items() if w not in self.added}
            self.fast = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    @property
    def whole(self):
        """The library's encoder; most processes never need it."""
        if self._whole is None:
            from tokenizers import Tokenizer

            self._whole = Tokenizer.from_file(self.path)
        return self._whole

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if self.fast is None or any(a in text for a in self.added):
            return np.asarray(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text)


class RankEncoder:
    """ids of texts by a ranks file (base64 token and rank on each line)."""

    def __init__(self, path: str):
        import base64

        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        self.fast = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str | None) -> np.ndarray:
        return self.fast.encode_to_numpy(text) if text else np.zeros(0, np.uint32)


_encoders: dict[str, Encoder | RankEncoder] = {}


def encoder(path: str) -> Encoder | RankEncoder:
    """The encoder of a file, made once in each process."""
    if path not in _encoders:
        _encoders[path] = (RankEncoder if path.endswith(".tiktoken") else Encoder)(path)
    return _encoders[path]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def counts(texts: Sequence[str | None], path: str) -> np.ndarray:
    own = encoder(path)
    return np.fromiter((len(own.ids(t)) for t in texts), np.int64, len(texts))
