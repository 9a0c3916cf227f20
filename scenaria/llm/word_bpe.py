"""Word-level BPE with word ends, as the vocabulary file word_bpe_49k.json describes it.

The text is put into NFC, lower-cased and cut at white space, which is dropped.
No pre-token crosses white space, so every piece between white space can be
worked out by itself and remembered; only pieces that were not seen before cost
more than a dictionary lookup. The memory is bounded: it is emptied when full.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator

#: The pre-token pattern of the vocabulary file.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: str.split() also cuts at these, which are no white space to the tokenizer.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_SPACE = re.compile("[\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Bytes that print as themselves in Latin-1 do so; the others follow from
    code point 256 on, in order.
    """
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class WordVocabulary:
    """What the file says: symbols, merges in order, special strings, pattern."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        model = said["model"]
        self.path = path
        self.ids: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"]
        self.ranks = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): r for r, m in enumerate(model["merges"])}
        self.special = {x["content"]: x["id"] for x in said["added_tokens"]}
        self.special_pattern = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.pre_token = regex.compile(PRE_TOKEN)
        self.normaliser = Tokenizer.from_file(path).normalizer
        self.split = pre_tokenizers.Split(Regex(PRE_TOKEN), "removed", invert=True)
        self.symbols = byte_symbols()

    def cut(self, piece: str) -> list[str]:
        """Pre-tokens of a piece; beyond Latin letters by the library, whose tables of newer characters may differ."""
        if max(piece, default="") < "\u0250":
            return self.pre_token.findall(piece)
        return [x for x, _ in self.split.pre_tokenize_str(piece)]

    def normalise(self, text: str) -> str:
        """NFC, then lower case one character at a time (no rule for a final sigma).

        By the library where a character is so new that its tables and Python's may differ.
        """
        if text.isascii():
            return text.lower()
        if all(map(_settled.__getitem__, set(text))):
            return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return self.normaliser.normalize_str(text)

    def spell(self, pre_token: str) -> list[str]:
        """The symbols that merging starts from."""
        out = [self.symbols[b] for b in pre_token.encode("utf-8", "surrogatepass")]
        out[-1] += self.end
        return out

    def merge(self, symbols: list[str]) -> list[str]:
        """Plain BPE: the best-ranked pair first, from the left."""
        parts, ranks = list(symbols), self.ranks
        while len(parts) > 1:
            best = min((ranks.get(pair, 1 << 30) for pair in zip(parts, parts[1:], strict=False)), default=1 << 30)
            if best == 1 << 30:
                break
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and ranks.get((parts[i], parts[i + 1])) == best:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts


def pieces(text: str) -> list[str]:
    """The pieces between white space."""
    if _SEPARATORS.search(text):
        return [x for x in _SPACE.split(text) if x]
    return text.split()


def latin_word(piece: str) -> str:
    """The letters of a piece that is Latin letters and perhaps closing punctuation, which are two pre-tokens; else empty."""
    body = piece.rstrip(".,;:!?")
    return body if body.isalpha() and max(body) < "\u0250" else ""


class Remembered(dict):
    """piece -> value, worked out on first use; emptied when it holds `most`."""

    def __init__(self, work: Callable[[str], object], most: int):
        super().__init__()
        self.work, self.most = work, most

    def __missing__(self, piece: str):
        value = self.work(piece)
        if len(self) >= self.most:
            self.clear()
        if len(piece) <= 64:
            self[piece] = value
        return value


def _in_all_tables(c: str) -> bool:
    """Whether a character has been there since Unicode 3.2, what it composes to and its class never change then; or is a symbol, which composes with nothing."""
    return unicodedata.ucd_3_2_0.category(c) != "Cn" or unicodedata.category(c) == "So"


_settled = Remembered(_in_all_tables, 200_000)


def runs(vocabulary: WordVocabulary, text: str) -> Iterator[tuple[int | None, str]]:
    """The text between special strings as (None, text), and these as (id, "")."""
    if "<|" not in text:
        yield None, text
        return
    at = 0
    for m in vocabulary.special_pattern.finditer(text):
        yield None, text[at : m.start()]
        yield vocabulary.special[m[0]], ""
        at = m.end()
    yield None, text[at:]


class LibraryEncoder:
    """Ids as the tokenizers library gives them, packed as unsigned 32-bit integers.

    The library's model gets each new pre-token once, already in normal form; a
    piece made of letters and closing punctuation is put together from its parts.
    """

    def __init__(self, path: str, most: int = 250_000):
        from tokenizers import Tokenizer

        self.vocabulary = WordVocabulary(path)
        self.model = Tokenizer.from_file(path).model
        self.words = Remembered(self._word, most)
        self.known = Remembered(self._piece, most)

    def _word(self, pre_token: str) -> bytes:
        spelt = pre_token if pre_token.isalnum() and pre_token.isascii() else "".join(map(self.vocabulary.symbols.__getitem__, pre_token.encode("utf-8", "surrogatepass")))
        return array("I", [t.id for t in self.model.tokenize(spelt)]).tobytes()

    def _piece(self, piece: str) -> bytes:
        body = latin_word(piece)
        if body:
            return self.words[body] + (self.words[piece[len(body) :]] if len(body) < len(piece) else b"")
        return b"".join(map(self.words.__getitem__, self.vocabulary.cut(piece)))

    def encode(self, text: str) -> bytes:
        known, out = self.known, []
        for special, part in runs(self.vocabulary, text):
            out.append(array("I", [special]).tobytes() if special is not None else b"".join(map(known.__getitem__, pieces(self.vocabulary.normalise(part)))))
        return out[0] if len(out) == 1 else b"".join(out)
