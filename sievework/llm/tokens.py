"""Token ids of whole texts, through the tokenizers library, with a memo of words.

Both tokenizer files cut a text into words before they merge anything, and every such
cut falls where a white-space run follows another character.  A text is therefore the
concatenation of its pieces ``white space + word``, and the library needs to see each
distinct piece once per worker only.  Pieces are cut and put together as arrays, and those of
plain letters go to the library's model, which they reach as one word each.  Texts with white space on
which Python and the library could disagree, or with the string of a special token, go to the library whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa

from sievework.llm.common import kept

#: White space that cuts texts.
IS_SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
#: White space beyond the ASCII characters that every definition has.
ODD_SPACE = re.compile(r"[^\S\t-\r ]")
#: A piece that ends in sentence marks behind a letter or digit: a sure cut for both files.
MARKED = re.compile(r"(.*[^\W_])([.,;:!?]+)", re.S)
#: Stands between pieces that are encoded in one go.  The code point is not assigned, so it
#: is a word of its own for both files, and no other text has its bytes.
BETWEEN = "\u0378"
#: Pieces encoded in one go.
TOGETHER = 2000
#: A worker remembers twice so many pieces at most (250 bytes each), or so many characters.
MEMO_PIECES, MEMO_CHARS = 100_000, 16_000_000
SPACE = " \n\t\r\x0b\x0c"
#: Pieces that are one word for the pre-tokenizers of ``_word_form``: letters of Latin-1, whose lower case and
#: composed form are not in doubt.
LETTERS = re.compile("[ ]?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
#: Characters that stand for bytes in byte-level models, by byte.
BYTE_CHARS = {b: chr(b) for b in [*range(0x21, 0x7f), *range(0xa1, 0xad), *range(0xae, 0x100)]}
BYTE_CHARS |= {b: chr(0x100 + k) for k, b in enumerate(b for b in range(256) if b not in BYTE_CHARS)}
#: Normalizer and pre-tokenizer of the two known kinds of tokenizer files.
_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True}
BYTE_KIND = (None, _LEVEL | {"use_regex": True})
WORD_KIND = ({"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {
        "Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        _LEVEL | {"use_regex": False}]})


def _word_form(config: dict) -> Callable[[str], str] | None:
    """What the model of a tokenizer is given for a piece of ``LETTERS``; None for files of another kind."""
    kind = (config["normalizer"], config["pre_tokenizer"])
    if kind == BYTE_KIND:
        return lambda piece: piece.encode().decode("latin-1").translate(BYTE_CHARS)
    if kind == WORD_KIND:
        return lambda piece: piece.strip(" ").lower().encode().decode("latin-1").translate(BYTE_CHARS)
    return None


def _odd_space(text: str) -> bool:
    if text.isascii():  # of the ASCII characters only these
        return "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text
    return ODD_SPACE.search(text) is not None


class Ids:
    """Encodes texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str, memo_pieces: int = MEMO_PIECES, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.form, self.model = _word_form(json.loads(self.tokenizer.to_str())), self.tokenizer.model
        names = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(names) or r"(?!)", re.IGNORECASE)
        shared = os.path.commonprefix([t.content for t in self.tokenizer.get_added_tokens_decoder().values()])
        self.mark = re.match(r"\W*", shared)[0]  # no text without it has a special string
        self.between = np.frombuffer(self.whole([f"a {BETWEEN}"])[0], "<u4")[len(self.whole(["a"])[0]) // 4:]
        self.memo_pieces = memo_pieces
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.chars = 0

    def whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", x.ids).tobytes() for x in found]

    def together(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces that may follow ``BETWEEN``: one text, cut where its ids occur."""
        data = self.whole([f" {BETWEEN}".join(pieces)])[0]
        ids, mark = np.frombuffer(data, "<u4"), self.between
        hit = ids[:max(0, len(ids) - len(mark) + 1)] == mark[0]
        for k in range(1, len(mark)):
            hit &= ids[k:len(ids) - len(mark) + 1 + k] == mark[k]
        ends = (4 * np.flatnonzero(hit)).tolist()
        if len(ends) != len(pieces) - 1:
            return self.whole(pieces)
        starts = [0, *(e + 4 * len(mark) for e in ends)]
        return [data[a:b] for a, b in zip(starts, [*ends, len(data)])]

    def learn(self, pieces: set[str]) -> None:
        memo, older, marks = self.memo, self.older, ".,;:!?"
        back = pieces & older.keys()
        memo.update((p, older[p]) for p in back)
        new = pieces - back if back else pieces
        cut = {p: m.groups() for p in new if p[-1] in marks and (m := MARKED.fullmatch(p))}
        plain = new.difference(cut)
        plain.update(part for parts in cut.values() for part in parts if part not in memo)
        if self.form:
            form, tokenize = self.form, self.model.tokenize
            words = [p for p in plain if LETTERS.fullmatch(p)]
            memo.update((p, array("I", [t.id for t in tokenize(form(p))]).tobytes()) for p in words)
            plain.difference_update(words)
        easy = [p for p in plain if p[-1] not in SPACE and (p[0] in SPACE or p[0].isalnum())]
        odd = list(plain.difference(easy))
        for at in range(0, len(easy), TOGETHER):
            part = easy[at:at + TOGETHER]
            memo.update(zip(part, self.together(part)))
        memo.update(zip(odd, self.whole(odd)))
        memo.update((p, memo[word] + memo[end]) for p, (word, end) in cut.items())
        self.chars += sum(map(len, pieces))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; a null counts as empty."""
        if len(self.memo) > self.memo_pieces or self.chars > MEMO_CHARS:  # words still in use come back from the older half
            self.older, self.memo, self.chars = self.memo, {}, 0
        mark, special = self.mark, self.special.search
        whole = [bool(t) and (_odd_space(t) or (mark in t and special(t) is not None)) for t in texts]
        data = [b"" if w or not t else t.encode() for t, w in zip(texts, whole)]
        found = self._by_pieces(data)
        return [self.whole([t])[0] if w else ids for t, w, ids in zip(texts, whole, found)]

    def _by_pieces(self, data: list[bytes]) -> list[bytes]:
        """Ids of texts in UTF-8.  A piece is a white-space run with the word after it, or the run that ends the text."""
        joined = b"".join(data)
        if not joined:
            return [b""] * len(data)
        ends = np.cumsum([len(d) for d in data])
        starts = np.r_[0, ends[:-1]]
        space = IS_SPACE[np.frombuffer(joined, np.uint8)]
        cut = space.copy()
        cut[1:] &= ~space[:-1]
        cut[starts[starts < ends]] = True
        at = np.flatnonzero(cut)
        offsets = np.r_[at, len(joined)].astype(np.int64)
        pieces = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(joined)]).dictionary_encode()
        distinct = pieces.dictionary.to_pylist()
        missing = set(distinct).difference(self.memo)
        if missing:
            self.learn(missing)
        known = list(map(self.memo.__getitem__, distinct))
        flat = np.frombuffer(b"".join(known), "<u4")
        many = np.fromiter(map(len, known), np.int64, len(known)) // 4
        which = pieces.indices.to_numpy()
        n = many[which]
        behind = np.r_[0, np.cumsum(n)]
        ids = flat[np.arange(behind[-1]) + np.repeat((np.cumsum(many) - many)[which] - behind[:-1], n)].tobytes()
        first, last = 4 * behind[np.searchsorted(at, starts)], 4 * behind[np.searchsorted(at, ends)]
        return [ids[a:b] for a, b in zip(first.tolist(), last.tolist())]


def ids_of(path: str, memo_pieces: int = MEMO_PIECES, special_as_text: bool = False) -> Ids:
    """The encoder of this worker process for a tokenizer file.

    The string of a special token in a text is that token, as the library has it; with
    ``special_as_text`` it is ordinary text.
    """
    loaded = kept("tokens")
    key = (path, special_as_text)
    if key not in loaded:
        loaded[key] = Ids(path, memo_pieces, special_as_text)
    loaded[key].memo_pieces = memo_pieces
    return loaded[key]
