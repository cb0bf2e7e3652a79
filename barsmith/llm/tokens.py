"""Token ids of whole texts, with a bounded memo of words."""

from __future__ import annotations

import os
import string
import unicodedata

import numpy as np

#: ASCII marks that a tokenizer cuts off a word; an apostrophe may start a contraction, so it is not one.
MARKS = string.punctuation.replace("'", "")
#: Words in a worker's memo before it starts afresh, and letters of the longest word that stays in it: 200 to 400 bytes each.
MEMO, LONGEST = 400_000, 64
#: Code points tokenized together.
TOGETHER = 1 << 21

_LOADED: dict[str, Words] = {}


def default_path() -> str:
    """Where this installation keeps the vocabulary of the packing query."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Words:
    """Ids as little-endian unsigned 32-bit bytes.

    If the tokenizer drops white space and never joins across it, which is tried on a few strings when it
    is loaded, a text's ids are those of its words in a row; most words of a corpus have been seen before.
    New words go to the tokenizer together, parted by a mark; ASCII marks at a word's end are looked up
    apart, as the tokenizer parts them from letters too. Other tokenizers get whole texts.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.memo: dict[str, bytes] = {"": b""}
        probes = ["a", "The", "don't", "x,", "é1", "'s", "0"]
        ids = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        self.by_word = all(ids(a + gap + b) == ids(a) + ids(b) for a in probes for b in probes for gap in (" ", "\n", "  "))
        self.by_word &= ids("ab,.") == ids("ab") + ids(",.") and ids("É") == ids("é") and len(ids("0")) == 1
        self.mark = ids("0")[0]
        # words of lower-case letters need no normalising and no splitting but at spaces
        self.light = Tokenizer.from_file(path)
        self.light.normalizer = None
        self.light.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        trial = "a the schön été ñandú слово 0 語"
        if self.light.encode(trial, add_special_tokens=False).ids != ids(trial):
            self.light = self.tokenizer

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Words of lower-case letters only, so that the mark, a digit, is in none."""
        ids = np.array(self.light.encode_batch_fast([" 0 ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        at = np.flatnonzero(ids == self.mark) * 4
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *(at + 4).tolist()], [*at.tolist(), len(raw)])]

    def _learn(self, new: set[str], lowered: bool) -> None:
        memo = self.memo
        letters = {w for w in new if w.isalpha()}
        stems = {w: s for w in new - letters if (s := w.rstrip(MARKS)).isalpha()}
        odd = new.difference(letters, stems)
        ends = {w[len(s) :] for w, s in stems.items()}
        letters.update(stems.values())
        if not lowered:
            strange = {w for w in letters if w != w.lower() or not unicodedata.is_normalized("NFC", w)}
            letters -= strange
            odd |= strange
        whole = list(letters.difference(memo))
        for i in range(0, len(whole), 1024):
            memo.update(zip(whole[i : i + 1024], self._encode_words(whole[i : i + 1024])))
        whole = list((odd | ends).difference(memo))
        memo.update(zip(whole, self._encode(whole)))
        for w, s in stems.items():
            memo[w] = memo[s] + memo[w[len(s) :]]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return self._encode(texts)
        low = [_lower(t) for t in texts]
        words = [(t if x is None else x).replace("\n", " ").split(" ") for t, x in zip(texts, low)]
        if len(self.memo) > MEMO:
            self.memo.clear()
            self.memo[""] = b""
        new = set().union(*words).difference(self.memo)
        self._learn(new, None not in low)
        find = self.memo.__getitem__
        found = [b"".join(map(find, w)) for w in words]
        for w in new:
            if len(w) > LONGEST:  # blobs are not seen twice
                self.memo.pop(w, None)
                self.memo.pop(w.rstrip(MARKS), None)
        return found


def _lower(text: str) -> str | None:
    """Lower case, or None where that could change what the tokenizer's own normalising makes of the text."""
    if text.isascii():
        return text.lower()
    low = text.lower()
    plain = "\u03a3" not in text and "\u0130" not in text
    return low if plain and unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", low) else None


def words(path: str) -> Words:
    """The tokenizer of this worker process, loaded once."""
    if path not in _LOADED:
        _LOADED[path] = Words(path)
    return _LOADED[path]
