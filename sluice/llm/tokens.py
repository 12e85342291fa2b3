"""Sub-word encoding of whole texts with a public vocabulary, one word at a time."""

from __future__ import annotations

import os
import re
import struct
from array import array

#: Words kept in a worker's memory before the store is emptied and filled anew.
CACHE_WORDS = 1_200_000
CACHE_CHARS = 24 << 20
#: New words that the library encodes in one call.
TOGETHER = 200


def vocabulary(name: str) -> str:
    """Where the installed public vocabulary *name* lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Ids of whole texts, as little-endian unsigned 32-bit integers.

    The vocabulary's splitting rule never lets a token run over a single space between
    two characters that aren't white space, so a text's ids are those of its pieces cut
    before each such space.  Pieces are encoded once and then looked up; other spaces
    keep their neighbours together.  The result equals encoding the text in one call.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        added = self._tokenizer.get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or t.single_word for t in added.values()):
            raise ValueError("an added token that takes what stands around it")
        self._added = {t.content: struct.pack("<I", k) for k, t in added.items()}
        self._at_added = re.compile("|".join(re.escape(t) for t in sorted(self._added, key=len, reverse=True))) if added else None
        if self._tokenizer.normalizer is not None or type(self._tokenizer.pre_tokenizer).__name__ != "ByteLevel":
            raise ValueError("a byte-level vocabulary without normalisation is needed")
        byte_level = self._tokenizer.pre_tokenizer.pre_tokenize_str
        # how byte-level vocabularies spell each byte: printable Latin-1 stands for itself, the rest follows from U+0100
        plain = [b for b in range(256) if chr(b).isprintable() and chr(b) != " "]
        self._spelling = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(sorted({*range(256)} - {*plain}))}
        if byte_level(" \u00e9")[0][0] != " \u00e9".encode().decode("latin-1").translate(self._spelling):
            raise ValueError("unknown spelling of bytes")
        self._split = regex.compile(public_tokenizers.PATTERN).findall  # byte-level vocabularies' splitting rule
        self._words: dict[str, bytes] = {}
        self._limit = cache_words
        self._chars = 0  # of all words kept
        self._inner: dict[str, bytes | bool] = {}
        self._whole: dict[str, bytes] = {}

    def _encode(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece by the library's own merges, each word of a piece merged once."""
        merge, spell, inner, words, out = self._tokenizer.model.tokenize, self._spelling, self._inner, self._words, []
        if len(words) > self._limit // 4:
            words.clear()
        for p in pieces:
            ids = []
            for word in (p,) if p[1:].isalpha() and p[0] == " " else self._split(p):
                known, name = (inner, word[1:]) if word[0] == " " and word[1:].isalpha() else (words, word)
                if (got := known.get(name)) is None:
                    got = known[name] = array("I", [x.id for x in merge(word.encode().decode("latin-1").translate(spell))]).tobytes()
                ids.append(got)
            out.append(ids[0] if len(ids) == 1 else b"".join(ids))
        return out

    def _learn(self, texts: set[str]) -> None:
        """Inner pieces: those that follow a space. False: that space can't be cut at."""
        unsafe = {p for p in texts if not p or p[0].isspace() or p[-1].isspace()}
        safe = texts - unsafe
        self._chars += sum(map(len, texts))
        inner = self._inner
        if len(inner) + len(texts) > self._limit:
            inner.clear()
        inner.update(dict.fromkeys(unsafe, False))
        rest, alone = [], []
        for p in safe:
            (alone if p.isalpha() else rest).append(p)
        for k in range(0, len(alone), TOGETHER):  # pieces of one word of the splitting rule, in one call
            some = alone[k : k + TOGETHER]
            got = self._tokenizer.encode(" " + " ".join(some), add_special_tokens=False)
            ids, starts = array("I", got.ids).tobytes(), {}
            for at, word in enumerate(got.word_ids):
                starts.setdefault(word, 4 * at)
            if len(starts) == len(some):
                at = [*starts.values(), len(ids)]
                inner.update(zip(some, map(ids.__getitem__, map(slice, at, at[1:]))))
            else:  # the library parts a word that Python takes for one
                rest += some
        inner.update(zip(rest, self._encode([" " + p for p in rest])))

    def _pieces(self, words: list[str]) -> list[str]:
        out, last = [], words[0]
        for w in words[1:]:
            if last and w and not last[-1].isspace() and not w[0].isspace():
                out.append(last)
                last = " " + w
            else:
                last += " " + w
        return [*out, last]

    def _forget_much(self) -> None:
        if self._chars > CACHE_CHARS:
            for held in (self._words, self._inner, self._whole):
                held.clear()
            self._chars = 0

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """One value per text; null counts as empty.  Added tokens part a text wherever they are spelled out."""
        parted = {k: self._at_added.split(t) for k, t in enumerate(texts) if t and any(x in t for x in self._added)}
        if not parted:
            return self._plain(texts)
        parts = iter(self._plain([p for k, t in enumerate(texts) for p in parted.get(k, [t])]))
        out = []
        for k, t in enumerate(texts):
            ids = next(parts)
            for token in self._at_added.findall(t) if k in parted else ():
                ids += self._added[token] + next(parts)
            out.append(ids)
        return out

    def _plain(self, texts: list[str | None]) -> list[bytes]:
        self._forget_much()
        split = [(t or "").split(" ") for t in texts]
        got = [list(map(self._inner.get, words)) for words in split]
        lack: set[str] = set()
        holes = []
        for words, found in zip(split, got):
            found[0] = b""  # the first piece follows no space
            holes.append(at := [i for i, x in enumerate(found) if not x])
            lack.update(map(words.__getitem__, at[1:]))
        lack -= self._inner.keys()
        if lack:
            self._learn(lack)
        slow = []
        for k, (words, found, at) in enumerate(zip(split, got, holes)):
            if len(words) > 1 and (not words[0] or words[0][-1].isspace()):
                slow.append(k)
                continue
            for i in at[1:]:
                if (x := self._inner.get(words[i], False)) is False:
                    slow.append(k)
                    break
                found[i] = x
        parts = {k: self._pieces(split[k]) for k in slow}
        firsts = {w[0] for k, w in enumerate(split) if k not in parts} | {p for x in parts.values() for p in x}
        new = list(firsts - self._whole.keys())
        self._chars += sum(map(len, new))
        if len(self._whole) + len(new) > self._limit // 4:
            self._whole.clear()
            new = list(firsts)
        self._whole.update(zip(new, self._encode(new)))
        return [
            b"".join(map(self._whole.__getitem__, parts[k])) if k in parts else self._whole[words[0]] + b"".join(got[k])
            for k, words in enumerate(split)
        ]


def encoder(path: str, cache_words: int = CACHE_WORDS, _kept: dict = {}) -> WordEncoder:  # noqa: B006
    """This worker process's encoder for *path*; made once, used by all its tasks."""
    if (path, cache_words) not in _kept:
        _kept[path, cache_words] = WordEncoder(path, cache_words)
    return _kept[path, cache_words]
