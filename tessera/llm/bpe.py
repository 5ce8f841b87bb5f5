"""Exact byte-level BPE encoding with a memory of units.

A byte-level pre-tokeniser that keeps one leading space with the word after it never joins characters across
the place before a single space, or before a single newline, that stands between two other characters. A text
without runs of white space can therefore be cut there into units, and the ids of a text are the ids of its
units in order. Units repeat, so each is encoded once and remembered. Texts with runs of white space, and texts that
hold an added token of the vocabulary, go to the tokeniser whole. Both ways give the ids that the tokenizers library,
with its defaults and add_special_tokens=False, gives for the whole text.
"""

from __future__ import annotations

import os
from array import array

import numpy as np
import public_tokenizers

CUT = "\x00"
#: Texts with one of these, or with white space at an end, are encoded whole.
RUNS = ("  ", " \n", "\n ", "\n\n", CUT)
#: Marks that may follow a word and form one run of their own there.
TAIL = ".,!?;:%$#&*|"
MARK, LINE = "\u0120", (198).to_bytes(2, "little")


def byte_chars() -> list[str]:
    """The printable character that stands for each byte: itself if printable, else the next one from 256 on."""
    kept = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b if b in kept else extra))
        extra += b not in kept
    return out


BYTE_CHARS = byte_chars()


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    return public_tokenizers.path(name)


class Memory(dict):
    """Ids of units; a unit asked for the first time is encoded then."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, unit: str) -> bytes:
        ids = self[unit] = self.make(unit)
        return ids


class Encoder:
    """``room`` bounds the remembered units of this process."""

    def __init__(self, path: str, room: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.whole = (*RUNS, *[t.content for t in self.tok.get_added_tokens_decoder().values()])
        self.room, self.memory, self.words, self.tails = room, Memory(self.unit), {}, {}
        line = self.tok.encode("a\nb", add_special_tokens=False).ids
        self.by_unit = len(line) == 3 and self.tok.get_vocab_size() <= 65536 and line[1].to_bytes(2, "little") == LINE

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=np.uint32).astype(np.uint16).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def unit(self, u: str) -> bytes:
        """Ids of a new unit: a run of letters with marks after it by the model, anything else by the whole tokeniser."""
        first = u[0]
        core = u[1:] if first == " " or first == "\n" else u
        tail = b""
        if not core.isalpha():
            body = core.rstrip(TAIL)
            if not body.isalpha():
                return self._whole([u])[0]
            tail = core[len(body) :]
            core = body
            tail = self.tails.get(tail) or self.tails.setdefault(tail, self._whole([tail])[0])
        mark = MARK if first == " " else ""
        key = mark + core
        ids = self.words.get(key)
        if ids is None:
            if not core.isascii():
                key = mark + "".join(map(BYTE_CHARS.__getitem__, core.encode()))
            ids = self.words[mark + core] = array("H", [x.id for x in self.model.tokenize(key)]).tobytes()
        return (LINE + ids if first == "\n" else ids) + tail

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text as uint16; null counts as empty."""
        texts = [x or "" for x in texts]
        if not self.by_unit:
            return [np.array(e.ids, dtype=np.uint32) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        if len(self.memory) > self.room:
            self.memory.clear()
        if len(self.words) > self.room:
            self.words.clear()
        get, out = self.memory.__getitem__, []
        for x in texts:
            if not x:
                out.append(b"")
            elif any(map(x.__contains__, self.whole)) or x[0].isspace() or x[-1].isspace():
                out.append(self._whole([x])[0])
            else:
                out.append(b"".join(map(get, x.replace(" ", "\x00 ").replace("\n", "\x00\n").split(CUT))))
        return [np.frombuffer(x, dtype=np.uint16) for x in out]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
