"""Token ids of whole texts, fast: the tokenizers library runs once per new word.

The vocabulary drops white space and never joins across it, so the ids of a
text are those of its blank- or newline-separated chunks, one after another.
Each task keeps the ids of chunks it has met, in two generations of a bounded
number of short chunks; text written without blanks is one long chunk, which is
forgotten with its batch.  Chunks are handed to the library a batch at a time.
"""

from __future__ import annotations

from array import array
from functools import lru_cache

import numpy as np

from ferrule.llm.common import KEPT

VOCABULARY = "word_bpe_49k.json"
#: Appended to each document.
END_ID = 2
#: Chunks of more characters are not kept.
LONGEST = 64


class ChunkEncoder:
    def __init__(self, path: str, most: int = 350_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.most, self.now, self.before, self.long = most, {}, {}, set()
        self.final = np.zeros(self.library.get_vocab_size(with_added_tokens=True), bool)
        for token, i in self.library.get_vocab().items():
            self.final[i] = token.endswith("</w>")

    def forget(self) -> None:
        self.now, self.before, self.long = {}, {}, set()

    def _words(self, words: list[str]) -> None:
        """Words of plain letters, many in one call: each is one unit of the vocabulary's
        pre-tokenizer, whose last id, and no other, is marked as the end of a word."""
        for at in range(0, len(words), 1000):
            part = words[at : at + 1000]
            ids = np.array(self.library.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            ends = np.flatnonzero(self.final[ids]) + 1
            if len(ends) != len(part):  # not a vocabulary of this kind
                self._chunks(part)
                continue
            flat, start = ids.tobytes(), 0
            for word, end in zip(part, (ends * 4).tolist(), strict=True):
                self.now[word] = flat[start:end]
                start = end

    def _chunks(self, chunks: list[str]) -> None:
        for at in range(0, len(chunks), 4096):
            part = chunks[at : at + 4096]
            for chunk, e in zip(part, self.library.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.now[chunk] = array("I", e.ids).tobytes()

    def learn(self, texts: list[str]) -> list[list[str]]:
        """The chunks of each text, all of them known afterwards."""
        now = self.now
        if len(now) > self.most:
            self.before, self.now = now, {}
            now = self.now
        cut = [t.replace("\n", " ").split(" ") for t in texts]
        words, stops, rest = set(), [], []
        new = set().union(*cut) - now.keys()
        self.long = {x for c in new if len(c) > LONGEST for x in (c, c[:-1])}
        for chunk in new:
            got = self.before.get(chunk)
            if got is not None:
                now[chunk] = got
                continue
            stop = chunk[-1:] in (",", ".")
            word = chunk[:-1] if stop else chunk
            # letters up to U+00FF stay single letters when normalised and lower-cased
            if word.isalpha() and (word.isascii() or max(word) < "\u0100"):
                if word not in now:
                    words.add(word)
                if stop:
                    stops.append((chunk, word))
            else:
                rest.append(chunk)
        self._words(sorted(words))
        self._chunks([*rest, *({",", "."} - now.keys())])
        for chunk, word in stops:
            now[chunk] = now[word] + now[chunk[-1]]
        return cut

    def encode(self, texts: list[str], end_id: int | None = END_ID) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, with the end id."""
        end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        cut = self.learn(texts)
        out = [b"".join(map(self.now.__getitem__, c)) + end for c in cut]
        for chunk in self.long:
            self.now.pop(chunk, None)
        return out


@lru_cache(2)
def encoder(path: str) -> ChunkEncoder:
    """One per Python worker, which Spark uses for many tasks."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    one = ChunkEncoder(path)
    KEPT.append(one)
    return one


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)
