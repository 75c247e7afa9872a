"""Token ids of whole texts with a public tokenizer file.

The tokenizer lower-cases, drops white space and encodes runs of letters, single digits and runs of
other signs on their own, so a text's ids are those of its space-separated chunks one after another, and a chunk's
those of such parts. Texts are cut into lower-case parts with numpy, and each Python worker keeps the ids of parts that it has met, which are far fewer than
chunks. A chunk that may hold a special token, an apostrophe or other characters than ASCII's and the letters from U+00C0 to U+00FF isn't cut but
encoded as it stands.
"""

from __future__ import annotations

import re

import numpy as np

#: Ends a document.
END = 0

_SIGNS = rb"[!-&(-/:-@\[-`{-~]"
#: Lower-case letters that normalisation leaves alone: a-z, and those from U+00DF to U+00FF.
_PART = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+|[0-9]|" + _SIGNS + rb"+")
_ENDING = re.compile(rb"(.*[^!-/:-@\[-`{-~])(" + _SIGNS + rb"+)", re.S)
_SPACE = re.compile(rb"[ \t-\r]")

#: Bytes of a text that are cut at a time, about.
RUN_BYTES = 1 << 20
SPACE, LETTER, SIGN, DIGIT, ODD = range(5)
_LEAD = 0xC3  # first byte of U+00C0 to U+00FF


def _kinds() -> np.ndarray:
    out = np.full(256, ODD, np.uint8)
    out[[32, *range(9, 14)]] = SPACE
    out[[*range(65, 91), *range(97, 123), _LEAD]] = LETTER
    out[48:58] = DIGIT
    out[[c for c in range(256) if re.fullmatch(_SIGNS, bytes([c]))]] = SIGN
    return out


_KIND = _kinds()
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def spaced(text: bytes) -> bytes:
    """The text with A-Z and U+00C0 to U+00DE in lower case and a space between parts, but for chunks that must stay as they are."""
    raw = np.frombuffer(text, np.uint8)
    low, kind = _FOLD[raw], _KIND[raw]
    at = np.flatnonzero(raw[:-1] == _LEAD) + 1
    if len(at):
        second = raw[at]
        fine = (second != 0x97) & (second != 0xB7)  # multiplication and division signs
        kind[at[fine]] = LETTER
        low[at[fine & (second < 0x9F)]] += 32
    odd = np.flatnonzero(kind == ODD)
    if b"<|" in text:
        odd = np.append(odd, np.flatnonzero((raw[:-1] == 60) & (raw[1:] == 124)))
    before, after = kind[:-1], kind[1:]
    cut = ((before != after) | (after == DIGIT)) & (before != SPACE) & (after != SPACE)
    if len(odd):
        chunk = np.cumsum(kind == SPACE)
        whole = np.zeros(int(chunk[-1]) + 1, bool)
        whole[chunk[odd]] = True
        whole = whole[chunk]
        low = np.where(whole, raw, low)
        cut &= ~whole[1:]
    place = np.arange(len(raw))
    place[1:] += np.cumsum(cut)
    out = np.full(len(raw) + int(np.count_nonzero(cut)), 32, np.uint8)
    out[place] = low
    return out.tobytes()


def _byte_signs() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(other)) for b in range(256)]


_BYTE_SIGNS = str.maketrans(dict(enumerate(_byte_signs())))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Ids(dict):
    """part, or chunk that stays as it is (UTF-8) -> its ids as little-endian unsigned 32-bit bytes."""

    LIMIT = 500_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.bytes = [k.to_bytes(4, "little") for k in range(self.tokenizer.get_vocab_size())]

    def _encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _made(self, chunk: bytes) -> bytes:
        if b"<|" in chunk:
            return self._encode(chunk.decode("utf-8", "replace"))
        if _PART.fullmatch(chunk):  # normalisation and splitting change nothing in one such part
            text, packed = chunk.decode() if chunk.isascii() else chunk.decode("latin-1").translate(_BYTE_SIGNS), self.bytes
            return b"".join([packed[t.id] for t in self.tokenize(text)])
        low = chunk.lower()  # A-Z only
        if low != chunk:
            return self[low]
        if m := _ENDING.fullmatch(chunk):
            if m[1].decode("utf-8", "replace")[-1].lower().isalpha():
                return self[m[1]] + self[m[2]]
        return self._encode(chunk.decode("utf-8", "replace"))

    def __missing__(self, chunk: bytes) -> bytes:
        ids = self._made(chunk)
        if len(chunk) <= 64:
            if len(self) >= self.LIMIT:
                self.clear()
            self[chunk] = ids
        return ids

    def document(self, text: bytes) -> bytes:
        """Ids of a text and the end id. bytes.split() cuts at ASCII white space alone."""
        out, start = [], 0
        while start < len(text):
            end = _SPACE.search(text, start + RUN_BYTES)
            end = end.start() if end else len(text)
            out += map(self.__getitem__, spaced(text[start:end]).split())
            start = end
        out.append(END.to_bytes(4, "little"))
        return b"".join(out)


_held: dict[str, Ids] = {}


def ids_of(path: str) -> Ids:
    """This process's ids of a tokenizer file."""
    if path not in _held:
        _held[path] = Ids(path)
    return _held[path]
