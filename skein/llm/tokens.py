"""Token ids of whole texts by a public word BPE (lower case, word ends), equal to the tokenizers library's.

The library spends most of its time on bookkeeping for each piece. Texts of the plain alphabet (ASCII and Latin-1 letters,
whose lower case and normal form are simple) are therefore split here and the distinct words encoded by
tiktoken over the same vocabulary, a zero byte standing for the mark of a word's end. All other texts, and texts
that hold a special token's string, go to the tokenizers library as they are.
"""

from __future__ import annotations

import json
import re

import numpy as np

from skein.llm.common import store

VOCABULARY = "word_bpe_49k.json"
#: Words kept by a Python worker; beyond that the store starts anew.
STORE = 200_000

# The vocabulary file's own split pattern over the plain alphabet, and its special tokens.
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zà-öø-ÿß]+|[0-9]|[^\sa-zà-öø-ÿß0-9]+")
_SPECIAL = ("<|startoftext|>", "<|endoftext|>")
_ODD = re.compile(r"[^\t\n\r\x20-\x7eÀ-ÖØ-öø-ÿ]")
_END = "\x00"


def path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """encode(texts) gives an array of ids for each text."""

    def __init__(self, file: str | None = None):
        import tiktoken
        from tokenizers import Tokenizer

        file = file or path()
        self.library = Tokenizer.from_file(file)
        with open(file, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(sorted(set(range(256)) - set(plain)))}
        ranks, self.ends = {}, np.zeros(max(vocab.values()) + 1, bool)
        for token, i in vocab.items():
            if token in _SPECIAL:
                continue
            ended = token.endswith("</w>")
            ranks[bytes(byte[c] for c in (token[:-4] if ended else token)) + b"\x00" * ended] = i
            self.ends[i] = ended
        self.fast = tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, np.ndarray] = {}

    def _learn(self, words: list[str]) -> None:
        if len(self.known) + len(words) > STORE:
            self.known.clear()
        ids = np.array(self.fast.encode_ordinary(_END.join(words) + _END), dtype="<u4")
        stops = np.flatnonzero(self.ends[ids]) + 1
        raw, at = ids.tobytes(), 0
        for word, stop in zip(words, (stops * 4).tolist(), strict=True):
            self.known[word] = raw[at:stop]
            at = stop

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        split, out = [], []
        for x in texts:
            if _ODD.search(x) or ("<|" in x and any(s in x for s in _SPECIAL)):
                split.append(None)
            else:
                split.append(_SPLIT.findall(x.lower()))
        new = set()
        for words in split:
            if words:
                new.update(words)
        missing = list(new - self.known.keys())
        if missing:
            cleared = len(self.known) + len(missing) > STORE
            self._learn(list(new) if cleared else missing)
        known = self.known
        for x, words in zip(texts, split):
            if words is None:
                out.append(np.array(self.library.encode(x, add_special_tokens=False).ids, dtype="<u4"))
            else:
                out.append(np.frombuffer(b"".join([known[w] for w in words]), dtype="<u4"))
        return out


def encoder(file: str | None = None) -> Encoder:
    """One encoder a worker process."""
    known, file = store("tokens"), file or path()
    if file not in known:
        known[file] = Encoder(file)
    return known[file]
