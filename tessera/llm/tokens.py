"""Token ids from a tokenizers file, with a bounded memo of the pieces between white space."""

from __future__ import annotations

import json
import os
import re
from array import array
from itertools import chain

import numpy as np

from tessera.llm.common import kept

#: The characters with Unicode's White_Space property, which pre-tokenizers' \s means.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
#: ASCII punctuation and the letters of ASCII and Latin-1: between them, too, a pre-token ends.
PUNCTUATION = re.escape("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Entries of the memo, some 180 bytes each. It has two halves; when the newer one is full, the
#: older one is forgotten.
MEMO_ENTRIES = 1_200_000
TEXTS_AT_ONCE = 64

_plain_bytes = [*range(33, 127), *range(161, 173), *range(174, 256)]
_spare = iter(range(256, 512))
#: How byte-level tokenizers write each byte: printable ones as themselves, the others from U+0100 on.
BYTE_LETTERS = [chr(b if b in _plain_bytes else next(_spare)) for b in range(256)]

_encoders: dict[tuple[str, bool, int], MemoEncoder] = kept.setdefault("tokens", {})


def _steps(path: str, part: str) -> list[dict]:
    """The steps of a tokenizers file's normalizer or pre-tokenizer."""
    with open(path, encoding="utf-8") as file:
        found = json.load(file).get(part)
    return found.get(f"{part.replace('_', '')}s", [found]) if found else []


class MemoEncoder:
    """Encodes texts as the library does, one stretch between white space at a time.

    A pre-token never runs from another character into white space, and what precedes such a
    place does not matter after it, so texts are cut there: each stretch is some white space and
    the characters that follow. A stretch that starts with letters is cut once more, before the
    first punctuation after them. ``drops_space`` holds for tokenizers in which white space leaves
    no trace; their stretches are kept without it. Texts that hold the string of an added token
    are given to the library whole.
    """

    def __init__(self, path: str, drops_space: bool, entries: int = MEMO_ENTRIES) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks of an executor share its cores already
        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        space, other, word = f"[{WHITE_SPACE}]", f"[^{WHITE_SPACE}]", f"[{LETTERS}]++(?=[{PUNCTUATION}])"
        pattern = f"{word}|{other}++" if drops_space else f"{space}*+{word}|{space}*+{other}++|{space}++"
        self.stretches = re.compile(pattern).findall
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        # a single pre-token, which the library's model can take without the steps before it
        self.plain = re.compile(f"{'' if drops_space else ' '}[{LETTERS}]+").fullmatch
        self.lowers = any(x["type"] == "Lowercase" for x in _steps(path, "normalizer"))
        self.model = self.tokenizer.model.tokenize
        self.entries = entries
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, self.dtype).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, stretches: list[str]) -> None:
        """Puts stretches into the memo, from the older one or by the library."""
        new = []
        for x in stretches:
            if (ids := self.older.get(x)) is None:
                new.append(x)
            else:
                self.memo[x] = ids
        kind = self.dtype.char
        for x in filter(self.plain, new):
            word = x.lower() if self.lowers else x
            written = word.replace(" ", BYTE_LETTERS[32]) if word.isascii() else "".join(map(BYTE_LETTERS.__getitem__, word.encode()))
            self.memo[x] = array(kind, [t.id for t in self.model(written)]).tobytes()
        other = [x for x in new if x not in self.memo]
        if other:
            self.memo.update(zip(other, self._library(other), strict=True))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """For each text its ids as little-endian numbers of ``self.dtype``; none for null or empty."""
        out: list[bytes] = []
        for at in range(0, len(texts), TEXTS_AT_ONCE):
            part = texts[at : at + TEXTS_AT_ONCE]
            whole = {i: self._library([x])[0] for i, x in enumerate(part) if x and any(y in x for y in self.added)}
            cut = [self.stretches(x) if x and i not in whole else [] for i, x in enumerate(part)]
            flat = list(chain.from_iterable(cut))
            found = list(map(self.memo.get, flat))
            missing = [i for i, x in enumerate(found) if x is None]
            if missing:
                self._learn(list(dict.fromkeys(flat[i] for i in missing)))
                for i in missing:
                    found[i] = self.memo[flat[i]]
            end = 0
            for i, x in enumerate(cut):
                start, end = end, end + len(x)
                out.append(whole[i] if i in whole else b"".join(found[start:end]))
            if len(self.memo) > self.entries // 2:
                self.older, self.memo = self.memo, {}
        return out


def encoder(path: str, drops_space: bool = False, entries: int = MEMO_ENTRIES) -> MemoEncoder:
    """One encoder for each Python worker and file."""
    key = (path, drops_space, entries)
    if key not in _encoders:
        _encoders[key] = MemoEncoder(path, drops_space, entries)
    return _encoders[key]
