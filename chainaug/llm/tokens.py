"""Token ids by the ``tokenizers`` library, for the packing and the token files.

The tokenizer file's content is broadcast (a few MB, whatever the data), so executors need no path."""

from __future__ import annotations

import functools
import json
import os
import re
from array import array
from operator import attrgetter
from string import punctuation

import numpy as np
from pyspark import Broadcast
from pyspark.sql import SparkSession

from .kernels import Words, chunks

_AFTER_SPACE = re.compile(r" (?<=\s )")
_REMEMBERED = 800_000  # words met lately whose ids a worker remembers, and as many met before (about 35 bytes each)
_CHUNK = 1 << 20  # more words a chunk, fewer of them distinct
_BLANK_WORDS = np.ones(256, dtype=bool)
_BLANK_WORDS[0x20] = False


def broadcast_tokenizer(spark: SparkSession, path: str) -> Broadcast:
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def _byte_letters() -> dict[int, str]:
    """The character that byte-level BPE writes for each byte: itself where it is printable in
    Latin-1, else the next one from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return {b: chr(b if b in printable else next(others)) for b in range(256)}


class WordTable:
    """Word hash -> (place, number) of its ids, as sorted arrays: a large layer, and a small one for
    new words that joins it from time to time, so adding words doesn't copy the whole table."""

    SMALL = 100_000

    def __init__(self) -> None:
        self.large = self.small = (np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))

    def __len__(self) -> int:
        return len(self.large[0]) + len(self.small[0])

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, number) of each hash; the place is -1 where it is not in the table."""
        at, count = np.full(len(wanted), -1, dtype=np.int64), np.zeros(len(wanted), dtype=np.int64)
        for known, places, counts in (self.large, self.small):
            if len(known):
                slot = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
                same = known[slot] == wanted
                at[same], count[same] = places[slot[same]], counts[slot[same]]
        return at, count

    def add(self, rows: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        """New hashes, sorted, with their places and numbers."""
        def merge(old: tuple, new: tuple) -> tuple:
            slot = np.searchsorted(old[0], new[0])
            return tuple(np.insert(o, slot, n) for o, n in zip(old, new))

        self.small = merge(self.small, rows)
        if len(self.small[0]) > self.SMALL:
            self.large = merge(self.large, self.small)
            self.small = tuple(x[:0] for x in self.small)


class Encoder:
    """Texts -> ids.

    Byte-level BPE with its usual pattern never joins a character that is not white space to a blank
    that follows, so such a text can be cut before its blanks and each distinct word of a batch encoded
    once; a worker also remembers the words of earlier batches.  Texts with other white space before a
    blank, texts that hold the content of an added token (which the library matches first), and texts for
    any other tokenizer, are encoded whole."""

    def __init__(self, content: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        spec = json.loads(content)
        pre = spec.get("pre_tokenizer") or {}
        self.by_word = (
            spec.get("normalizer") is None and pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
        )
        self.tokenizer = Tokenizer.from_str(content)
        self.added = [a["content"] for a in spec.get("added_tokens") or [] if a["content"]]
        self.letters = _byte_letters()
        self.marks: dict[str, bytes] = {}
        self.known, self.ids, self.used = WordTable(), np.empty(1 << 16, np.uint32), 0  # words met lately, their ids
        self.older, self.older_ids = WordTable(), np.empty(0, np.uint32)  # words met before those

    def _add(self, hashes: np.ndarray, ids: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Remember words (hashes sorted) and their ids, end to end; returns where the ids lie."""
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.empty_like(self.ids)))
        self.ids[self.used : self.used + len(ids)] = ids
        at = self.used + np.cumsum(count) - count
        self.used += len(ids)
        self.known.add((hashes, at, count))
        return at

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of each " " + word.  A word of letters and a closing run of marks is two pieces of the pattern."""
        tokenize, number, letters = self.tokenizer.model.tokenize, attrgetter("id"), self.letters
        split = []
        for word in words:
            head = word.rstrip(punctuation)
            split.append((head, word[len(head) :]) if head[-1:].isalnum() else (word, ""))
        if len(self.marks) > _REMEMBERED // 10:
            self.marks = {}
        marks = list({m for _, m in split}.difference(self.marks.keys()))
        self.marks.update(zip(marks, self._whole(marks)))
        plain: dict[str, bytes] = {}
        other = []
        for head in {h for h, _ in split}:
            if head.isalpha():
                spelt = head if head.isascii() else head.encode().decode("latin-1").translate(letters)
                plain[head] = array("I", map(number, tokenize(letters[0x20] + spelt))).tobytes()
            else:
                other.append(head)
        plain.update(zip(other, self._whole([" " + w for w in other])))
        known = self.marks
        return [plain[h] + known[m] if m else plain[h] for h, m in split]

    def _lookup(self, words: Words, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in ``ids`` the ids of the words numbered ``rest`` lie, and how many they are."""
        distinct, first, back = np.unique(words.hash[rest], return_index=True, return_inverse=True)
        if len(self.known) and len(self.known) + len(distinct) > _REMEMBERED:
            self.older, self.older_ids = self.known, self.ids[: self.used].copy()
            self.known, self.ids, self.used = WordTable(), np.empty(1 << 16, np.uint32), 0
        at, count = self.known.find(distinct)
        new = np.flatnonzero(at < 0)
        before, again = self.older.find(distinct[new])
        met = before >= 0
        if met.any():
            old = new[met]
            count[old] = again[met]
            at[old] = self._add(distinct[old], _gather(self.older_ids, before[met], again[met]), again[met])
        fresh = new[~met]
        if len(fresh):
            where = rest[first[fresh]]
            found = self._words([words.buf[s:e].tobytes().decode() for s, e in zip(words.start[where].tolist(), words.end[where].tolist())])
            count[fresh] = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
            at[fresh] = self._add(distinct[fresh], np.frombuffer(b"".join(found), dtype=np.uint32), count[fresh])
        return at[back], count[back]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids (uint32) of each text; null is empty."""
        texts = [t or "" for t in texts]
        whole = [not self.by_word or t[:1] == " " or t[-1:] == " " or bool(_AFTER_SPACE.search(t))
                 or any(a in t for a in self.added) for t in texts]
        out: list[np.ndarray | None] = [None] * len(texts)
        rest = [i for i, w in enumerate(whole) if w]
        for i, ids in zip(rest, self._whole([texts[i] for i in rest])):
            out[i] = np.frombuffer(ids, dtype=np.uint32)
        rest = [i for i, w in enumerate(whole) if not w]
        raw = [texts[i].encode() for i in rest]
        for lo, hi in chunks(raw, _CHUNK):
            here = rest[lo:hi]
            words = Words(raw[lo:hi], _BLANK_WORDS)
            begins = words.first[:-1][np.diff(words.first) > 0]
            inner = np.ones(len(words.hash), dtype=bool)
            inner[begins] = False  # the first word of a text has no blank before it
            inner = np.flatnonzero(inner)
            at, count = self._lookup(words, inner)
            heads = self._whole([texts[i].split(" ", 1)[0] for i in here])
            upto = np.concatenate(([0], np.cumsum(count)))
            flat = _gather(self.ids, at, count)
            cut = np.searchsorted(inner, words.first)
            for k, i in enumerate(here):
                out[i] = np.concatenate((np.frombuffer(heads[k], dtype=np.uint32), flat[upto[cut[k]] : upto[cut[k + 1]]]))
        return out


def _gather(ids: np.ndarray, at: np.ndarray, count: np.ndarray) -> np.ndarray:
    """ids[at[k] : at[k] + count[k]] for every k, end to end."""
    end = np.cumsum(count)
    return ids[np.repeat(at - (end - count), count) + np.arange(end[-1] if len(end) else 0)]


@functools.cache
def _encoder(content: str) -> Encoder:
    return Encoder(content)


def encoder(tokenizer: Broadcast) -> Encoder:
    """The worker's encoder for a broadcast tokenizer file."""
    return _encoder(tokenizer.value)
