"""BPE encoding and decoding by a tokenization automaton (operator 2).

The automaton accepts exactly the token sequences that the merges produce.  It
starts with one state that loops on every byte.  Each merge (u, v), in order,
adds a gadget: the arcs labelled u now enter a new state that copies the arcs of
their old end but lacks v, and wherever v could follow u there is an arc
labelled uv to where v led.  Which state an arc enters depends on its label
alone, so the automaton is deterministic.  Copied arcs are shared with the state
they were copied from, and the arcs that a walk has met are kept in a table.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import MEMORIES, map_batches
from .token_cache import PieceCutter

TABLE_LIMIT = 1_500_000
"""Most arcs that a worker's table of transitions holds; then it starts afresh."""
REMEMBERED = 250_000
"""Pieces remembered before the older half of the memory goes; those in use move to the newer half."""
CHARS = 5_000_000
"""Characters whose pieces are numbered together."""


def byte_symbols() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary.

    Printable bytes stand for themselves; the others, in order, are the
    characters from 256 on.
    """
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return [chr(b) if b in printable else chr(256 + others.index(b)) for b in range(256)]


class TokenizationAutomaton:
    """Compiled from byte tokens and ordered merges; all tokens are integer ids."""

    def __init__(self, labels: dict[int, bytes], merges: list[tuple[int, int, int]]):
        self.labels = labels
        n = max(labels, default=-1) + 1
        self.born = [-1] * n  # the merge that made a token's arcs; -1: there from the start
        self.left = [-1] * n  # the token whose arcs say where a merged token's arcs start
        self.enters = [0] * n  # the state that a token's arcs enter
        # A state: where its arcs were copied from, the token it belongs to, the merge that made it.
        self.copied_from, self.owner, self.made = [0], [-1], [-1]
        self.below = [0]  # the state beneath all gadgets of the same owner
        self.lacks: dict[tuple[int, int], int] = {}
        self.first: dict[tuple[int, int], int] = {}  # the first gadget of an owner above a state
        live = {t for t, label in labels.items() if len(label) == 1}
        for rank, (u, v, w) in enumerate(merges):
            old, target = self.enters[u], self.enters[v]
            if u not in live or v not in live or not self.has_arc(old, v):
                continue  # earlier merges leave no place where v follows u
            live.add(w)
            self.copied_from.append(old)
            self.owner.append(u)
            self.made.append(rank)
            self.below.append(self.below[old] if self.owner[old] == u else old)
            self.first.setdefault((u, self.below[-1]), rank)
            self.lacks[u, v] = rank
            self.enters[u] = len(self.made) - 1
            self.born[w], self.left[w], self.enters[w] = rank, u, target
        self.next: list[dict[int, int]] = [{}]
        self.accepts = [-1]
        for token, label in labels.items():
            if token in live:
                node = 0
                for byte in label:
                    if byte not in self.next[node]:
                        self.next[node][byte] = len(self.next)
                        self.next.append({})
                        self.accepts.append(-1)
                    node = self.next[node][byte]
                self.accepts[node] = token
        self.table: dict[int, bool] = {}

    def has_arc(self, state: int, token: int) -> bool:
        """Whether an arc labelled ``token`` leaves ``state``."""
        copied, owner, made, lacks = self.copied_from, self.owner, self.made, self.lacks
        while state:
            birth = self.born[token]
            if birth >= made[state]:  # the arc was added to this state, beside one of the left part
                token = self.left[token]
                continue
            own = owner[state]
            rank = lacks.get((own, token))
            if rank is not None and rank <= made[state]:
                return False
            # The arc is as in the newest state that it was added to, or in the one beneath the gadgets.
            floor = self.below[state]
            if made[floor] > birth or self.first[own, floor] > birth:
                state = floor
            else:
                while state != floor and made[state] > birth:
                    state = copied[state]
        return True

    def encode(self, word: bytes) -> list[int]:
        """The one accepted token sequence whose labels spell ``word``."""
        n = len(word)
        token_at, state_at = [-1] * (n + 1), [-1] * (n + 1)
        state_at[0] = 0
        table, accepts, nexts = self.table, self.accepts, self.next
        for j in range(n):
            state = state_at[j]
            if state < 0:
                raise ValueError("a byte of the text has no token")
            node = 0
            for i in range(j, n):
                node = nexts[node].get(word[i], 0)
                if not node:
                    break
                token = accepts[node]
                if token >= 0 and token_at[i + 1] < 0:
                    key = state << 32 | token
                    arc = table.get(key)
                    if arc is None:
                        arc = table[key] = self.has_arc(state, token)
                    if arc:
                        token_at[i + 1], state_at[i + 1] = token, self.enters[token]
        if len(table) > TABLE_LIMIT:
            table.clear()
        out = []
        while n:
            out.append(token_at[n])
            n -= len(self.labels[token_at[n]])
        return out[::-1]

    def decode(self, ids: list[int]) -> bytes:
        """The labels of the arcs, emitted one after another."""
        return b"".join(map(self.labels.__getitem__, ids))


PLAIN = re.compile(r" ?(?:[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+|[0-9]+)")
"""Pieces that every version of the split pattern leaves whole."""


class AutomatonTokenizer:
    """A byte-level tokenizer file, run by the automaton: split, encode, decode.

    The split into words is the library's own, so both agree on what is a
    letter or a number; settings that the automaton doesn't follow are refused.
    """

    def __init__(self, path: str):
        from tokenizers.pre_tokenizers import ByteLevel

        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        model = described["model"]
        if described.get("normalizer") or described["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            raise ValueError("only byte-level tokenizers without a normalizer are known")
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
        odd += [k for t in described["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized") if t.get(k)]
        if model.get("type", "BPE") != "BPE" or odd:
            raise ValueError(f"the automaton doesn't know {model.get('type')} with {odd}")
        byte_of = {c: b for b, c in enumerate(byte_symbols())}
        vocab = model["vocab"]
        labels = {i: bytes(byte_of[c] for c in t) for t, i in vocab.items() if all(c in byte_of for c in t)}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.automaton = TokenizationAutomaton(labels, [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs])
        self.special = {t["content"]: t["id"] for t in described["added_tokens"]}
        self.labels = labels | {i: t.encode() for t, i in self.special.items()}
        self.automaton.labels = self.labels
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.splitter = ByteLevel(add_prefix_space=False, use_regex=True)
        self.cutter = PieceCutter(path)
        self.new: dict[str, tuple[int, bytes, bytes]] = {}
        self.old: dict[str, tuple[int, bytes, bytes]] = {}

    def _plain(self, piece: str) -> list[int]:
        if PLAIN.fullmatch(piece):
            return self.automaton.encode(piece.encode())
        return [i for _, (a, b) in self.splitter.pre_tokenize_str(piece) for i in self.automaton.encode(piece[a:b].encode())]

    def encode(self, text: str) -> list[int]:
        """The ids of a text, or of a piece of one."""
        if self.at_special is None or not any(s in text for s in self.special):
            return self._plain(text) if text else []
        out: list[int] = []
        for part in self.at_special.split(text):
            out += [self.special[part]] if part in self.special else self._plain(part) if part else []
        return out

    def decode(self, ids: list[int]) -> str:
        return self.automaton.decode(ids).decode("utf-8", "replace")

    def _known(self, pieces: list[str]) -> list[tuple[int, bytes, bytes]]:
        """(ids, their numbers each with a comma, their labels) of each piece; what is new is encoded and remembered."""
        if len(self.new) > REMEMBERED:
            self.old, self.new = self.new, {}
        new, old, out = self.new, self.old, []
        for piece in pieces:
            value = new.get(piece)
            if value is None:
                value = old.get(piece)
                if value is None:
                    ids = self.encode(piece)
                    value = len(ids), "".join([f"{i}," for i in ids]).encode(), self.automaton.decode(ids)
                new[piece] = value
            out.append(value)
        return out

    def encoded(self, texts: list[str | None]) -> Iterator[tuple[int, bytes, bytes]]:
        """(number of ids, ids joined by commas, bytes decoded from them) of each text; Arrow numbers its pieces, each different one is encoded once."""
        for part in self.cutter.parts(texts, CHARS):
            codes, pieces, at, apart = self.cutter.cut(part)
            values = self._known(pieces)
            sizes = np.fromiter((v[0] for v in values), np.int64, len(values))
            total = np.concatenate([[0], np.cumsum(sizes[codes])])[at]
            joined = []
            for k in (1, 2):  # what follows one another in the array is one run of bytes
                each = pa.array([v[k] for v in values], pa.large_binary()).take(pa.array(codes))
                ends = np.frombuffer(each.buffers()[1], np.int64)[: len(each) + 1][at].tolist()
                run = memoryview(each.buffers()[2] or b"")
                joined.append([bytes(run[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)])
            for i, n in enumerate(np.diff(total).tolist()):
                if i in apart:
                    own = self._known(apart[i])
                    n, numbers, labels = sum(v[0] for v in own), b"".join(v[1] for v in own), b"".join(v[2] for v in own)
                else:
                    numbers, labels = joined[0][i], joined[1][i]
                yield n, numbers[:-1], labels


_made: dict[str, AutomatonTokenizer] = MEMORIES.setdefault("automaton", {})


def automaton_tokenizer(path: str) -> AutomatonTokenizer:
    """The worker's tokenizer of the file at ``path``."""
    if path not in _made:
        _made.clear()
        _made[path] = AutomatonTokenizer(path)
    return _made[path]


def encode_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row (key, ids) for each row; a null text counts as empty, extra columns are left out."""

    def make():
        tokenizer = automaton_tokenizer(path)

        def step(batch: dict | None) -> Iterator[dict]:
            if batch:
                for i in range(0, len(batch[key]), 500):
                    numbers = [numbers for _, numbers, _ in tokenizer.encoded(batch[text][i : i + 500])]
                    yield {key: batch[key][i : i + 500], "ids": [np.array(x.split(b","), np.int64) if x else [] for x in numbers]}

        return step

    return map_batches(docs.select(key, text), make, f"{key} {docs.schema[key].dataType.simpleString()}, ids array<int>", memory="automaton")


def decode_ids(encoded: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """A row (key, text) for each row (key, ids); null ids count as none."""

    def make():
        tokenizer = automaton_tokenizer(path)

        def step(batch: dict | None) -> Iterator[dict]:
            if batch:
                yield {key: batch[key], "text": [tokenizer.decode(x or []) for x in batch["ids"]]}

        return step

    return map_batches(encoded.select(key, "ids"), make, f"{key} {encoded.schema[key].dataType.simpleString()}, text string", memory="automaton")


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """Encode, then decode the ids: (doc_id, n_tokens, ids_sha256, decoded_sha256, same_text).

    A null text counts as empty (no ids, the digests of nothing).  Repeated
    rows, ties and null ids give a row each; an empty table gives none.
    """

    def make():
        tokenizer = automaton_tokenizer(path)
        sha = hashlib.sha256

        def step(batch: dict | None) -> Iterator[dict]:
            if not batch:
                return
            out: dict[str, list] = {"doc_id": batch["doc_id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "same_text": []}
            for text, (n, numbers, labels) in zip(batch["text"], tokenizer.encoded(batch["text"]), strict=True):
                decoded = labels.decode("utf-8", "replace")
                out["n_tokens"].append(n)
                out["ids_sha256"].append(sha(numbers).hexdigest())
                out["decoded_sha256"].append(sha(decoded.encode()).hexdigest())
                out["same_text"].append(decoded == (text or ""))
            yield out

        return step

    return map_batches(docs.select("doc_id", "text"), make, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string, same_text boolean", memory="automaton")
