"""Token ids of whole texts, as packed bytes, with a word cache per worker."""

from __future__ import annotations

import re
import struct

_SPACE = re.compile(r"\s")
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)")
_LATIN = [*range(65, 91), *range(97, 123), *(c for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7))]


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers; words are short, and an array for each costs more than this."""
    return struct.pack(f"<{len(ids)}I", *ids)


class TokenIds:
    """Ids as little-endian unsigned 32-bit integers, equal to
    ``Tokenizer.encode(text, add_special_tokens=False)``.

    A byte-level pre-tokenizer never joins what a single space or line break
    parts, if neither neighbour is white space. Such texts are cut there and
    each distinct piece goes through the tokenizer once; pieces of Latin letters
    and closing punctuation go straight to the tokenizer's merge model. Every
    other text or piece is encoded by the whole tokenizer. Each cache holds two
    generations of ``cache_size`` pieces at most; the older one goes first.
    """

    def __init__(self, path: str, cache_size: int = 300_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        pre = self.tokenizer.pre_tokenizer
        self.cuts = (
            type(pre).__name__ == "ByteLevel" and not pre.add_prefix_space and pre.use_regex and not self.tokenizer.normalizer
        )
        if self.cuts:
            self.letters = {c: pre.pre_tokenize_str(chr(c))[0][0] for c in _LATIN}
            self.space = pre.pre_tokenize_str(" a")[0][0][0]
            self.line = self._whole("\n")
        self.cache_size = cache_size
        self.marks: dict[str, bytes] = {}
        self.after_space, self.at_start = _Cache(self, " "), _Cache(self, "")

    def _whole(self, text: str) -> bytes:
        return packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _piece(self, lead: str, piece: str) -> bytes:
        word, marks = piece, ""
        if not (piece.isascii() and piece.isalpha()):
            plain = _PLAIN.fullmatch(piece)
            if not plain:
                if not piece or _SPACE.search(piece):
                    raise _Uncut
                return self._whole(lead + piece)
            word, marks = plain.groups()
        # a word with marks is often known without them
        ids = (self.after_space if lead else self.at_start).get(word) if marks else None
        if ids is None:
            tokens = self.model.tokenize((self.space if lead else "") + (word if word.isascii() else word.translate(self.letters)))
            ids = packed([t.id for t in tokens])
        if marks:
            if marks not in self.marks:
                if len(self.marks) > 10_000:
                    self.marks.clear()
                self.marks[marks] = self._whole(marks)
            ids += self.marks[marks]
        return ids

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.cuts or any(t in text for t in self.added):
            return self._whole(text)
        lines = []
        try:
            for line in text.split("\n"):
                words = iter(line.split(" "))
                lines.append(self.at_start[next(words)] + b"".join(map(self.after_space.__getitem__, words)))
        except _Uncut:
            return self._whole(text)
        return self.line.join(lines)


class _Uncut(Exception):
    """A piece next to, or with, white space that does not part tokens."""


class _Cache(dict):
    def __init__(self, ids: TokenIds, lead: str):
        self.ids, self.lead, self.older = ids, lead, {}

    def __missing__(self, piece: str) -> bytes:
        found = self.older.get(piece)
        if found is None:
            found = self.ids._piece(self.lead, piece)
        if len(self) >= self.ids.cache_size:
            self.older = dict(self)
            self.clear()
        self[piece] = found
        return found


def token_ids(path: str, cache_size: int = 300_000) -> TokenIds:
    """One encoder for each tokenizer file in a worker process. Functions travel
    with the job by value, so what outlives a task hangs on an imported module."""
    import tokenizers

    loaded = tokenizers.__dict__.setdefault("_lakewarden_encoders", {})
    if (path, cache_size) not in loaded:
        loaded[path, cache_size] = TokenIds(path, cache_size)
    return loaded[path, cache_size]
