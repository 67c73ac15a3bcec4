"""Token ids of whole texts, with each distinct run of text given to the tokenizer once.

Both tokenizers split a text at white space, and between letters and the symbols
behind them, before they merge symbols; a text cut there gives the same ids as its
parts. Texts are handled as columns: a batch is cut and its parts are numbered by
Arrow, only the distinct parts are looked up, and the ids of all parts are gathered
by offsets. A worker remembers the ids of the parts it has met (``MEMO`` at most,
then it begins anew); only new ones reach the ``tokenizers`` library: letters go
straight to its merge model, anything else through the whole tokenizer. Texts that
hold the string of a special token go to it whole.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from paceframe.llm import common

#: Parts that a worker remembers at most.
MEMO = 500_000
#: Characters of text whose parts are held at a time.
STEP_CHARS = 2_000_000
#: Parts that go to the library in one call, and whose ids are gathered at a time.
CALL, GATHER = 4_000, 500_000
#: White space of Unicode, as the tokenizers see it.
_WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_CUT = re.compile(f"(?<![{_WHITE}])(?=[ \n])")
_ODD_WHITE = ("  ", "\n\n", " \n", "\n ", *(c for c in _WHITE + "\x1c\x1d\x1e\x1f" if c not in " \n"))
#: A comma or full stop behind a letter or digit, and before a blank or line end: a piece of its own.
_STOP = re.compile(r"[.,](?=[ \n])(?<=[^\W_][.,])")
#: Stands where a text is cut; texts that hold it go to the library whole.
_MARK = "\x01"
#: A blank or line end, letters, and symbols that are a piece of their own (an apostrophe may not be).
_LETTERS = re.compile(r"([ \n]?)([^\W\d_]+)([!-&(-/:-@\[-`{-~]*)")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones themselves, the others 256 and on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def _plain_runs(text: str) -> bool:
    """Every run of white space is one blank or line end, and none stands in front."""
    return text[:1] not in (" ", "\n") and not any(c in text for c in _ODD_WHITE)


class Encoder:
    """Ids of texts for a ``tokenizers`` file, as little-endian unsigned 16-bit numbers."""

    def __init__(self, path: str, memo: int | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        common.release_memory()
        self.library = Tokenizer.from_file(path)
        if self.library.get_vocab_size() > 1 << 16:
            raise ValueError("ids above 65535 are not supported")
        with open(path, encoding="utf-8") as file:
            kind = json.load(file)
        self.specials = [t["content"] for t in kind.get("added_tokens") or []]
        #: The tokenizer of words: white space gives no ids, and case goes.
        self.of_words = "Removed" in json.dumps(kind["pre_tokenizer"])
        if self.of_words:
            self.specials.append("Σ")  # its small form depends on the place in the word
        self.letters = byte_letters()
        self.mark = " \x01 " if self.of_words else "\n"
        ids = self._ids(["\x01" if self.of_words else "\n"])[0]
        if len(ids) != 1:
            raise ValueError("the parting character has no id of its own")
        self.mark_id = ids[0]
        self.most = MEMO if memo is None else memo
        self._forget()

    def _forget(self) -> None:
        #: The number of each part met; by number, where its ids begin among all ids, and how many they are.
        self.memo: dict[str, int] = {}
        self.ids, self.begins, self.sizes = array("H"), array("q"), array("q")

    def _remember(self, part: str, ids: list[int]) -> None:
        self.memo[part] = len(self.begins)
        self.begins.append(len(self.ids))
        self.sizes.append(len(ids))
        self.ids.extend(ids)

    def _known(self, part: str) -> list[int]:
        at = self.memo[part]
        return self.ids[self.begins[at] : self.begins[at] + self.sizes[at]].tolist()

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _marked(self, text: str) -> str:
        """The text with a mark where it is cut; parts carry the blank or line end in front of them."""
        text = _STOP.sub(f"{_MARK}\\g<0>", text)
        if self.of_words:
            return text.lower().replace("\n", _MARK).replace(" ", _MARK)
        if _plain_runs(text):
            return text.replace(" ", f"{_MARK} ").replace("\n", f"{_MARK}\n")
        return _CUT.sub(_MARK, text)

    def _learn_letters(self, part: str, tokenize: Callable) -> None:
        """``part``: letters, in a tokenizer of bytes perhaps with a blank in front."""
        spelled = part if part.isascii() and part[0] != " " else part.encode().decode("latin-1").translate(self.letters)
        self._remember(part, [t.id for t in tokenize(spelled)])

    def _learn(self, new: list[str]) -> None:
        memo, tokenize = self.memo, self.library.model.tokenize
        made_of: list[tuple[str, tuple]] = []  # part: the parts that its ids are made of
        others: set[str] = set()
        for part in new:
            if (part[1:] if part[:1] == " " else part).isalpha() and (not self.of_words or part.isascii() or unicodedata.is_normalized("NFC", part)):
                if part not in memo:
                    self._learn_letters(part, tokenize)
                continue
            found = _LETTERS.fullmatch(part)
            if not found or not found[2].isalpha() or (self.of_words and not unicodedata.is_normalized("NFC", part)):
                others.add(part)
                continue
            front, core, tail = found.groups()
            pieces = ("\n", core, tail) if front == "\n" else (front + core, tail)
            if pieces[-2] not in memo:
                self._learn_letters(pieces[-2], tokenize)
            others.update(pieces[:-2], [tail])
            made_of.append((part, pieces))
        self._learn_others([p for p in others if p not in memo])
        for part, pieces in made_of:
            self._remember(part, [i for p in pieces for i in self._known(p)])

    def _learn_others(self, new: list[str]) -> None:
        together, alone = [], []
        for p in new:
            clear = "\x01" not in p and p.strip() if self.of_words else p[:1] == " " and p[1:] and not any(map(str.isspace, p[1:]))
            (together if clear else alone).append(p)
        for i in range(0, len(together), CALL):
            some = together[i : i + CALL]
            ids = self._ids([self.mark.join(some) + self.mark])[0]
            ends = [k for k, x in enumerate(ids) if x == self.mark_id]
            if len(ends) != len(some):
                alone += some
                continue
            start = 0
            for p, end in zip(some, ends, strict=True):
                self._remember(p, ids[start:end])
                start = end + 1
        for i in range(0, len(alone), CALL):
            some = alone[i : i + CALL]
            for p, ids in zip(some, self._ids(some), strict=True):
                self._remember(p, ids)

    def encode(self, texts: list[str], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all whole texts in a row (each with ``end_id`` behind it, if given), and where each begins (and the last one ends)."""
        if not texts:
            return np.zeros(0, "<u2"), np.zeros(1, np.int64)
        whole = {k for k, t in enumerate(texts) if _MARK in t or any(s in t for s in self.specials)}
        cut = pc.split_pattern(pa.array(["" if k in whole else self._marked(t) for k, t in enumerate(texts)], pa.large_string()), _MARK)
        offsets = cut.offsets.to_numpy().astype(np.int64)
        numbered = cut.values.dictionary_encode()
        index, parts = numbered.indices.to_numpy().astype(np.int64), numbered.dictionary.to_pylist()
        new = [p for p in parts if p not in self.memo]
        if len(self.memo) + len(new) > self.most:
            self._forget()
            new = parts
        self._learn(new)
        index = np.fromiter(map(self.memo.__getitem__, parts), np.int64, len(parts))[index]
        # Behind the ids of all parts: those of texts that went to the library whole, and the end.
        sizes, begins, more = [np.array(self.sizes)], [np.array(self.begins)], [np.array(self.ids)]
        extra = [self._ids([texts[k]])[0] for k in sorted(whole)] + ([[end_id]] if end_id is not None else [])
        index[offsets[sorted(whole)]] = len(self.sizes) + np.arange(len(whole))
        if end_id is not None:
            index = np.insert(index, offsets[1:], len(self.sizes) + len(whole))
            offsets = offsets + np.arange(len(offsets))
        if extra:
            sizes.append(np.array([len(x) for x in extra]))
            begins.append(len(self.ids) + np.cumsum(sizes[1]) - sizes[1])
            more += [np.array(x, "<u2") for x in extra]
        sizes, places, flat = np.concatenate(sizes).astype(np.int64), np.concatenate(begins).astype(np.int64), np.concatenate(more).astype("<u2")
        ends = np.concatenate([[0], np.cumsum(sizes[index])])
        ids = np.empty(ends[-1], "<u2")
        for at in range(0, len(index), GATHER):
            some = index[at : at + GATHER]
            a, b = ends[at], ends[at + len(some)]
            shift = places[some] - ends[at : at + len(some)]
            ids[a:b] = flat[np.repeat(shift, sizes[some]) + np.arange(a, b)]
        return ids, ends[offsets]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str, memo: int | None = None) -> Encoder:
    """The worker's encoder for a file."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = Encoder(path, memo)
    return _ENCODERS[path]
