"""Token ids by the tokenizers library, which sees each distinct piece of a worker's texts once."""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from docketflow.llm import pieces as P

#: Words of Latin letters are one pre-token.
WORD = f" ?[{P.LETTERS}]+"
WORD_LINES = re.compile(f"^({WORD})$|^.*$", re.MULTILINE).findall


def byte_characters() -> str:
    """The character that byte-level tokenizers write each byte as: printable ones as themselves, the rest from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (chr(256 + n) for n in range(256))
    return "".join(chr(b) if b in printable else next(others) for b in range(256))


class Library:
    """Ids of pieces. Plain words are cut here and go straight to the library's merges; the rest goes through the whole tokenizer."""

    def __init__(self, tokenizer):
        self.tokenizer, self.model = tokenizer, tokenizer.model
        plain = [(i, t.content) for i, t in tokenizer.get_added_tokens_decoder().items() if not (t.lstrip or t.rstrip or t.single_word or t.normalized)]
        self.mark_id, self.mark = plain[0] if plain else (None, None)
        self.characters = byte_characters()
        self.lower = tokenizer.normalizer is not None and tokenizer.normalizer.normalize_str("AÉ") == "aé"
        self.cuts = self._cuts()

    def written(self, pre_token: str) -> str:
        """Pre-tokens as the library's merges want them."""
        pre_token = pre_token.lower() if self.lower else pre_token
        return pre_token.encode().decode("latin-1").translate(self.characters)

    def _cuts(self) -> bool:
        """Whether the tokenizer cuts and writes plain words as it is done here, and cuts marks and lines off them, tried on all their letters."""
        if any(re.fullmatch(f"[{P.LETTERS}]*[{re.escape(P.MARKS)}]*", t.content) for t in self.tokenizer.get_added_tokens_decoder().values()):
            return False
        letters = [c for c in map(chr, range(65, 256)) if re.fullmatch(WORD, c)]
        normal, cut = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        for parts in P.trials(letters, lines=not self.lower):
            for first in (parts[0], *([" " + parts[0]] * (not self.lower and parts[0] != "\n"))):
                text = "".join([first, *parts[1:]])
                got = [w for w, _ in cut.pre_tokenize_str(normal.normalize_str(text) if normal else text)]
                if got != [self.written(p) for p in (first, *parts[1:])]:
                    return False
        return True

    def ask(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces by the library: flat, and how many each piece has."""
        if not self.cuts:
            return P.flat(self.whole(pieces))
        plain = WORD_LINES("\n".join(["" if "\n" in p else p for p in pieces])) if pieces else []
        words = iter(self.written("\n".join([w for w in plain if w])).split(self.written("\n")))
        others = iter(self.whole([p for p, w in zip(pieces, plain) if not w]))
        tokenize = self.model.tokenize
        return P.flat([[t.id for t in tokenize(next(words))] if w else next(others) for w in plain])

    def whole(self, pieces: list[str]) -> list[list[int]]:
        """Ids of each piece by the whole tokenizer. Where it can, one call has many, an added token, which nothing crosses, between them."""
        mark = self.mark
        joined = mark and mark.join([*pieces, ""])
        if mark and joined.count(mark) == len(pieces):
            ids = self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids
            ends = np.flatnonzero(np.array(ids) == self.mark_id).tolist()
            return [ids[a + 1 : b] for a, b in zip([-1, *ends], ends)]
        return [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]


class TextIds:
    """Ids of whole texts as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them.

    Two kinds of tokenizers are taken: byte-level ones without a normaliser, for which a single space that other than white
    space follows begins a pre-token; and those that drop white space, for which all pieces between white space stand alone.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.drops_space = self._drops_space()
        if not self.drops_space and not (isinstance(self.tokenizer.pre_tokenizer, pre_tokenizers.ByteLevel) and self.tokenizer.normalizer is None):
            raise ValueError("a tokenizer that drops white space or a byte-level one without normaliser is asked for")
        if any(ch.isspace() for t in added for ch in t):
            raise ValueError("added tokens must be free of white space")
        self.strange = P.strange_pattern(added)
        self.library = Library(self.tokenizer)
        self.pool = P.Pool(self.library.ask, self.library.cuts)

    def _drops_space(self) -> bool:
        def ids(text: str) -> list[int]:
            return self.tokenizer.encode(text, add_special_tokens=False).ids

        words = ["it's", "e", "\u0301a", "12", "--", "中"]
        return all(ids(f"{space}{a}{space}{b}{space}") == ids(a) + ids(b) for a in words for b in words for space in (" ", "  ", "\t", "\n", "\r\n", "\x0b", "\x0c"))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids one after the other, and each text's number of ids; null is empty."""
        texts = pc.fill_null(texts, "")
        return P.apart(self.pool, texts) if self.drops_space else P.spaced(self.pool, texts, self.strange, self.library.whole)


_ENCODERS: dict[str, TextIds] = {}


def encoder(path: str) -> TextIds:
    """The worker's encoder for a tokenizer file; its pool is to be cleared when a task ends."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TextIds(path)
    return _ENCODERS[path]
