"""Token ids of texts with a public tokenizer file, through a cache of words.

The tokenizer drops white space and never joins pieces across it, so the ids of a text are the ids of its
words in turn. A task keeps the ids of the words it has met. A word that is only letters skips
the tokenizer's normalisation, which is the identity on it after lower-casing, and goes straight to its
model; everything else is encoded in full.
"""

from __future__ import annotations

import unicodedata
from struct import pack

VOCABULARY = "word_bpe_49k.json"
END = 1
#: words a task keeps in each of two generations; the older one is dropped when the newer is full
KEPT_WORDS = 200_000


def _byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in a byte-level vocabulary: printable bytes stand for
    themselves, the others for code points from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordIds(dict):
    """Word to its ids as little-endian unsigned 32-bit numbers; words not met yet are encoded."""

    def __init__(self, path: str):
        super().__init__()
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.older: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= KEPT_WORDS:
            self.older = dict(self)
            self.clear()
        ids = self.older.get(word)
        if ids is None:
            ids = self.encoded(word)
        self[word] = ids
        return ids

    def encoded(self, word: str) -> bytes:
        tail = b""
        if word[-1:] in (".", ",") and word[:-1].isalpha():
            tail, word = self[word[-1]], word[:-1]
        if plain_letters(word):
            word = word.lower()
            if not word.isascii():
                word = word.encode().decode("latin-1").translate(self.letters)
            found = [t.id for t in self.model.tokenize(word)]
        else:
            found = self.tokenizer.encode(word, add_special_tokens=False).ids
        return pack(f"<{len(found)}I", *found) + tail

    def text(self, text: str) -> bytes:
        """The ids of a whole text, without an end id."""
        return b"".join([self[w] for w in text.replace("\n", " ").split(" ")])


def plain_letters(word: str) -> bool:
    """Letters only, in composed form, and of the Latin blocks where lower-casing keeps one letter one letter."""
    if not word.isalpha():
        return False
    return word.isascii() or (max(word) < "ɐ" and "İ" not in word and unicodedata.is_normalized("NFC", word))


def word_ids(path: str) -> WordIds:
    """A cache for one task; it goes when the task ends."""
    return WordIds(path)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
