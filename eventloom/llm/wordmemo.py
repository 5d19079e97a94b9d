"""Encoding with a bounded memo, exact to the tokenizers library's encoding of the whole text.

With a tokenizer whose pre-tokenizer drops white space and whose words carry an end mark, a text's ids are the ids of its
words in order. Words repeat a great deal, so that each is encoded by the library once a worker and then looked up.

Texts of ASCII and Latin-1 letters are cut into the pre-tokenizer's words here; others into white-space chunks, which the
library cuts itself; those with separators that only one side takes for white space are encoded whole.
"""

from __future__ import annotations

import os
import re

import numpy as np

from eventloom.llm.common import worker_cache

#: The library's normaliser only lower-cases a text without such a character; its special tokens begin with <|.
_NOT_PLAIN = re.compile(r"[^\t-\r -~À-ÖØ-öø-ÿ]")
#: Fixed value: the pre-tokenizer's pattern over these letters.
_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")
#: str.split() also splits at these four, which the library's \s doesn't.
_ODD = re.compile("[\x1c-\x1f]")
_LONG = 64


def load_tokenizer(path: str):
    """The tokenizers library's tokenizer in this process; Spark's tasks are the threads."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Memo:
    """Little-endian unsigned 32-bit ids of words, as bytes."""

    def __init__(self, tokenizer, most: int):
        self.tokenizer, self.most = tokenizer, most
        self.known: dict[str, bytes] = {}
        vocab = tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        for token, i in vocab.items():
            self.ends[i] = token.endswith("</w>")

    def encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Many words at a time; each token with an end mark ends a word."""
        groups, out = [words[i : i + 200] for i in range(0, len(words), 200)], []
        for group, data in zip(groups, self.encode([" ".join(g) for g in groups]), strict=True):
            ends = np.nonzero(self.ends[np.frombuffer(data, dtype="<u4")])[0] + 1
            if len(ends) != len(group):
                out += self.encode(group)
                continue
            ends = (4 * ends).tolist()
            out += [data[a:b] for a, b in zip([0, *ends], ends)]
        return out

    def ids(self, texts: list[str | None]) -> list[bytes]:
        texts = [t or "" for t in texts]
        plain = ["<|" not in t and not _NOT_PLAIN.search(t) for t in texts]
        cut = [_WORDS.findall(t.lower()) if p else (None if _ODD.search(t) else t.split()) for t, p in zip(texts, plain, strict=True)]
        if len(self.known) > self.most:
            self.known.clear()
        known = self.known
        words = set().union(*(c for c, p in zip(cut, plain, strict=True) if p)).difference(known)
        chunks = set().union(*(c for c, p in zip(cut, plain, strict=True) if not p and c)).difference(known, words)
        extra: dict[str, bytes] = {}
        for new, encode in ((list(words), self.encode_words), (list(chunks), self.encode)):
            for w, ids in zip(new, encode(new), strict=True):
                (known if len(w) <= _LONG else extra)[w] = ids
        out = []
        for t, c in zip(texts, cut, strict=True):
            if c is None:
                out.append(self.encode([t])[0])
            elif extra:
                out.append(b"".join([known[w] if w in known else extra[w] for w in c]))
            else:
                out.append(b"".join(map(known.__getitem__, c)))
        return out


def memo_of(path: str, most: int = 400_000) -> Memo:
    """This worker's memo; it outlives the task, and is bounded."""
    return worker_cache(("words", path, most), lambda: Memo(load_tokenizer(path), most))
