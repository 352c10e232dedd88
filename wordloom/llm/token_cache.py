"""Token ids of whole texts by the tokenizers library, a distinct piece at a time.

Texts are cut where the tokenizer itself always cuts, so the ids of the pieces
joined are the ids of the text: before a space that a word follows, between a
letter and a mark, and between a line's end and a letter.  Arrow numbers the
pieces; each Python worker remembers the ids of those that it has seen, within a
bound, as natural text repeats most of its words.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import chain

from .common import MEMORIES

LIMIT = 300_000
"""Pieces remembered before the older half of the memory goes; those in use move to the newer half."""
CHARS = 10_000_000
"""Characters whose pieces are numbered together."""
CUT = "\x1f"
"""Marks the cuts; texts that hold it are cut by themselves."""
TEXT = 1000
"""New pieces that are encoded as one text, where the tokenizer cuts between them."""

_BEFORE_WORD = re.compile(r"(?= \S)")
_UNSURE = re.compile(r" (?:\s|$)|<\|")  # a space that no word follows, an added token
# White space as Python sees it, for the regular expressions of Arrow.
_SPACES = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_ODD = rf" (?:[{_SPACES}]|$)|{CUT}"
_LETTER = r"[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]"


def default_path(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceCutter:
    """Cuts texts for the tokenizer file at ``path`` into pieces whose ids can be joined."""

    def __init__(self, path: str):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        self.np, self.pa, self.pc = np, pa, pc
        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        byte_level = described.get("normalizer") is None and described["pre_tokenizer"]["type"] == "ByteLevel"
        self.spaces_dropped = "\\s+" in json.dumps(described.get("normalizer")).replace("\\\\", "\\")
        if not (byte_level or self.spaces_dropped) or any(not t["content"].startswith("<|") for t in described["added_tokens"]):
            raise ValueError("it isn't known where texts for this tokenizer can be cut")

    def parts(self, texts: list[str | None], chars: int = CHARS) -> Iterator[list[str]]:
        """The texts in runs of about ``chars`` characters, nulls as empty ones."""
        part: list[str] = []
        size = 0
        for text in texts:
            part.append(text or "")
            size += len(part[-1])
            if size > chars:
                yield part
                part, size = [], 0
        if part:
            yield part

    def cut(self, texts: list[str]):
        """(codes, pieces, at, apart): text i is the pieces of ``codes[at[i]:at[i + 1]]``, or those of ``apart[i]``."""
        pa, pc = self.pa, self.pc
        array = pa.array(texts, pa.large_string())
        apart: dict[int, list[str]] = {}
        if self.spaces_dropped:  # white space only parts words, and ASCII letters are made small
            apart = {i: [texts[i]] for i in pc.indices_nonzero(pc.match_substring(array, CUT)).to_pylist()}
            array = pc.ascii_lower(pc.replace_substring(array, "\n", " "))
        else:
            apart = {i: _BEFORE_WORD.split(texts[i]) for i in pc.indices_nonzero(pc.match_substring_regex(array, _ODD)).to_pylist()}
        if apart:
            array = pc.if_else(pa.array([i in apart for i in range(len(texts))]), pa.scalar("", pa.large_string()), array)
        array = pc.replace_substring_regex(array, rf"({_LETTER})([.,!?;:\n])", rf"\1{CUT}\2")
        if self.spaces_dropped:
            array = pc.replace_substring(array, " ", CUT)
        else:
            array = pc.replace_substring_regex(array, rf"([^{_SPACES}]|{CUT})\n({_LETTER})", "\\1\n" + CUT + "\\2")
            array = pc.replace_substring(array, " ", CUT + " ")
        lists = pc.split_pattern(array, CUT)
        coded = lists.flatten().dictionary_encode()
        return coded.indices.to_numpy(), coded.dictionary.to_pylist(), lists.offsets.to_numpy(), apart


class PieceTokenizer(PieceCutter):
    """``ids(texts)`` gives for each text its ids as little-endian uint32 bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__(path)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = self.tokenizer.get_vocab()
        self.width = self.np.zeros(max(vocabulary.values(), default=-1) + 1, self.np.int64)
        """Bytes of each id; a byte-level token has a character for each."""
        for token, i in vocabulary.items():
            self.width[i] = len(token)
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def ids(self, texts: list[str | None], chars: int = CHARS) -> list[bytes]:
        return [ids for part in self.parts(texts, chars) for ids in self._ids(part)]

    def _ids(self, texts: list[str]) -> list[bytes]:
        np = self.np
        codes, keys, offsets, apart = self.cut(texts)
        values = self._known(keys)
        sizes = np.fromiter(map(len, values), np.int64, len(values)) // 4
        table = np.frombuffer(b"".join(values), "<u4")
        begin = np.cumsum(sizes) - sizes
        each = sizes[codes]
        ends = np.cumsum(each)
        ids = table[np.repeat((begin[codes] - (ends - each)).astype(np.int32), each) + np.arange(ends[-1], dtype=np.int32)]
        at = np.concatenate([[0], ends])[offsets].tolist()
        out = [ids[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
        for i, pieces in apart.items():
            out[i] = b"".join(self._known(pieces))
        return out

    def _known(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece; what is new is encoded and remembered."""
        if len(self.new) > LIMIT:
            self.old, self.new = self.new, {}
        values = list(map(self.new.get, pieces))
        fresh = [i for i, v in enumerate(values) if v is None]
        if self.old:
            missed, fresh = fresh, []
            for i in missed:
                p = pieces[i]
                v = self.old.get(p)
                if v is None:
                    fresh.append(i)
                else:
                    values[i] = self.new[p] = v
        for lo in range(0, len(fresh), 10_000):
            some = fresh[lo : lo + 10_000]
            named = [pieces[i] for i in some]
            encoded = self._encoded(named)
            self.new.update(zip(named, encoded, strict=True))
            for i, ids in zip(some, encoded, strict=True):
                values[i] = ids
        return values

    def _encoded(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece, as the library gives them.

        For a byte-level tokenizer the pieces that start before a word are encoded
        together, as it cuts between them, and parted by their bytes.
        """
        out = [b""] * len(pieces)
        if not self.spaces_dropped:
            joined = [i for i, p in enumerate(pieces) if p[:1] == " "]
            if _UNSURE.search("\n".join([pieces[i] for i in joined])):
                joined = [i for i in joined if not _UNSURE.search(pieces[i])]
            some = [pieces[i] for i in joined]
            for i, ids in zip(joined, self._parted(["".join(some[lo : lo + TEXT]) for lo in range(0, len(some), TEXT)], [len(p.encode()) for p in some]), strict=False):
                out[i] = ids
        alone = [i for i, ids in enumerate(out) if not ids]
        each = [e.ids for e in self.tokenizer.encode_batch_fast([pieces[i] for i in alone], add_special_tokens=False)]
        packed = self.np.fromiter(chain.from_iterable(each), "<u4").tobytes()
        at = 0
        for i, ids in zip(alone, each, strict=True):
            out[i] = packed[at : at + 4 * len(ids)]
            at += 4 * len(ids)
        return out

    def _parted(self, texts: list[str], sizes: list[int]) -> list[bytes]:
        """The ids of the pieces of ``sizes`` bytes that the texts consist of; none if a piece ends inside an id."""
        np = self.np
        ids = np.fromiter(chain.from_iterable(e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)), "<u4")
        reached, ends = np.cumsum(self.width[ids]), np.cumsum(sizes)
        at = np.searchsorted(reached, ends)
        if not len(ids) or reached[-1] != ends[-1] or (reached[at] != ends).any():
            return []
        packed, at = ids.tobytes(), (4 * (at + 1)).tolist()
        return [packed[a:b] for a, b in zip([0, *at[:-1]], at, strict=True)]


_made: dict[str, PieceTokenizer] = MEMORIES.setdefault("pieces", {})


def piece_tokenizer(path: str) -> PieceTokenizer:
    """The worker's tokenizer of the file at ``path``."""
    if path not in _made:
        _made.clear()
        _made[path] = PieceTokenizer(path)
    return _made[path]
