import hashlib
import json
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from wordloom.llm import bpe_automaton, packing, simple8b
from wordloom.llm.token_cache import PieceTokenizer, default_path

BYTE, WORDS = default_path("byte_bpe_50k.json"), default_path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def byte_library():
    return Tokenizer.from_file(BYTE)


@pytest.fixture(scope="module")
def automaton():
    return bpe_automaton.AutomatonTokenizer(BYTE)


def texts():
    rng = random.Random(2)
    out = ["", "  a  b \n c  ", "a" * 99, "<|endoftext|>x<|endoftext|> <|endoftext|", "don't WE'LL 123 日本 \U0001f389 \x1c\x1d é", "x\n\n\n  y\x85 z", "<|startoftext|> I'm Été İ é"]
    return out + ["".join(rng.choice(["a", "the ", "ing", " ", "'s", "\n", "\t", "12", "é", "ß", "!", "²", "Q", "\U0001f600"]) for _ in range(rng.randint(0, 40))) for _ in range(500)]


def test_automaton_equals_the_library(automaton, byte_library):
    for t, (n, numbers, labels) in zip(texts(), automaton.encoded(texts()), strict=True):
        ids = byte_library.encode(t, add_special_tokens=False).ids
        assert automaton.encode(t) == ids
        assert (n, numbers.decode(), labels.decode()) == (len(ids), ",".join(map(str, ids)), t)
        assert automaton.decode(ids) == byte_library.decode(ids, skip_special_tokens=False)


def test_automaton_splits_every_code_point_as_the_library(automaton, byte_library):
    points = [c for c in map(chr, range(0x110000)) if not 0xD800 <= ord(c) < 0xE000]
    for form in ("a{}b", " {}1", "{} x", ".{}\n"):
        some = ["|".join(form.format(c) for c in points[i : i + 400]) for i in range(0, len(points), 400)]
        want = [e.ids for e in byte_library.encode_batch_fast(some, add_special_tokens=False)]
        for text, ids, (n, numbers, labels) in zip(some, want, automaton.encoded(some), strict=True):
            assert n == len(ids) and numbers.decode() == ",".join(map(str, ids)) and labels.decode() == text


def test_automaton_refuses_what_it_does_not_follow(tmp_path):
    described = json.load(open(BYTE, encoding="utf-8"))
    described["model"]["vocab"] = {"a": 0, "b": 1, "ab": 2}
    described["model"]["merges"] = [["a", "b"]]
    path = tmp_path / "t.json"
    for change in ({}, {"ignore_merges": True}, {"dropout": 0.1}, {"byte_fallback": True}, {"end_of_word_suffix": "</w>"}, {"type": "WordPiece"}):
        path.write_text(json.dumps(described | {"model": described["model"] | change}))
        if change:
            with pytest.raises(ValueError):
                bpe_automaton.AutomatonTokenizer(str(path))
        else:
            assert bpe_automaton.AutomatonTokenizer(str(path)).encode("abba") == [2, 1, 0]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_automaton_on_any_text(text):
    t = bpe_automaton.automaton_tokenizer(BYTE)
    text = text.encode("utf-8", "ignore").decode()
    assert t.decode(t.encode(text)) == text


def slow_bpe(word, ranks):
    parts = list(word)
    while True:
        best = min((ranks[p], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in ranks) if any(p in ranks for p in zip(parts, parts[1:], strict=False)) else None
        if best is None:
            return parts
        pair = next(p for p, r in ranks.items() if r == best[0])
        out, i = [], 0
        while i < len(parts):
            if tuple(parts[i : i + 2]) == pair:
                out.append(parts[i] + parts[i + 1])
                i += 2
            else:
                out.append(parts[i])
                i += 1
        parts = out


def test_gadgets_of_random_merges():
    rng = random.Random(9)
    for _ in range(60):
        tokens, ranks = ["a", "b", "c"], {}
        for _ in range(rng.randint(1, 10)):
            pair = (rng.choice(tokens), rng.choice(tokens))
            if pair not in ranks and pair[0] + pair[1] not in tokens:
                ranks[pair] = len(ranks)
                tokens.append(pair[0] + pair[1])
        number = {t: i for i, t in enumerate(tokens)}
        machine = bpe_automaton.TokenizationAutomaton({i: t.encode() for t, i in number.items()}, [(number[a], number[b], number[a + b]) for a, b in ranks])
        for _ in range(40):
            word = "".join(rng.choice("abc") for _ in range(rng.randint(0, 12)))
            assert [tokens[i] for i in machine.encode(word.encode())] == slow_bpe(word, ranks)


def test_encode_and_decode_frames(spark, odd_docs, no_docs, byte_library):
    encoded = bpe_automaton.encode_documents(odd_docs, BYTE)
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in bpe_automaton.decode_ids(encoded, BYTE).collect()))) == sorted(map(str, ((r["doc_id"], r["text"] or "") for r in odd_docs.collect())))
    for r, d in zip(sorted(bpe_automaton.round_trip_digests(odd_docs, BYTE).collect(), key=str), range(odd_docs.count()), strict=True):
        assert r["same_text"]
    one = bpe_automaton.round_trip_digests(odd_docs.where("doc_id = 11"), BYTE).first()
    ids = byte_library.encode(odd_docs.where("doc_id = 11").first()["text"], add_special_tokens=False).ids
    assert (one["n_tokens"], one["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
    assert bpe_automaton.round_trip_digests(no_docs, BYTE).count() == 0


@pytest.mark.parametrize("path", [BYTE, WORDS])
def test_pieces_equal_the_library(path):
    library, pieces = Tokenizer.from_file(path), PieceTokenizer(path)
    for t, ids in zip(texts(), pieces.ids(texts()), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_new_words_reach_the_library_in_one_text():
    library, pieces = Tokenizer.from_file(BYTE), PieceTokenizer(BYTE)
    rng = random.Random(11)
    ends = ["", ".", ",\n", "\n\n", "\n", "'s", "\u00a0", "\u2003x", "\t", "\x1c", "<|endoftext|>", "<|", "\u0301", "\u4e2d", "\U0001f600"]
    some = ["".join(" " + "".join(rng.choice("abe1\u00e9\u00df\u4e2d!<|'") for _ in range(rng.randint(1, 9))) + rng.choice(ends) * (rng.random() < 0.3) for _ in range(40)) for _ in range(100)]
    given_over = []

    class Counting:
        def encode_batch_fast(self, batch, **how):
            given_over.extend(batch)
            return library.encode_batch_fast(batch, **how)

    pieces.tokenizer = Counting()
    for t, ids in zip(some, pieces.ids(some), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)
    assert sum(map(len, given_over)) > 10_000
    assert len(given_over) < 1000 < len(pieces.new)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60_000), st.integers(0, (1 << 64) - 1)), max_size=3000))
def test_simple8b_round_trip(ids):
    a = np.array(ids, np.uint64)
    assert (simple8b.unpack(*simple8b.pack(a), len(a)) == a).all()


def test_written_files(spark, odd_docs, no_docs, byte_library, tmp_path):
    path = str(tmp_path / "ids")
    simple8b.write_ids(odd_docs, path, BYTE)
    back = simple8b.read_ids(spark.read.parquet(path)).collect()
    want = sorted((-1 if r["doc_id"] is None else r["doc_id"], [*byte_library.encode(r["text"] or "", add_special_tokens=False).ids, 0]) for r in odd_docs.collect())
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], list(r["ids"])) for r in back) == want
    at = 0
    for r in sorted(back, key=lambda r: r["start"]):
        assert r["start"] == at and r["n_tokens"] == len(r["ids"])
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(back, key=lambda r: r["start"])]
    assert order[:2] == [None, None] and order[2:] == sorted(order[2:])
    assert simple8b.written_and_read(no_docs, BYTE).count() == 0


def test_nonnegative_least_squares():
    rng = np.random.default_rng(0)
    for _ in range(20):
        a, b = rng.random((6, 9)), rng.random(6)
        x = packing.nonnegative_least_squares(a, b)
        gain = a.T @ (b - a @ x)
        assert (x >= 0).all() and gain.max() < 1e-6 and abs(gain[x > 0]).max(initial=0) < 1e-6


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 15), st.integers(1, 40), max_size=15))
def test_plan_holds_every_length_once(histogram):
    left = dict(histogram)
    for repeats, combo in packing.plan(histogram, 16):
        assert repeats > 0 and sum(combo) <= 16
        for k in combo:
            left[k] -= repeats
    assert not any(left.values())


@pytest.mark.parametrize("which", ["documents", "odd_docs"])
def test_packing(request, which):
    docs = request.getfixturevalue(which)
    library = Tokenizer.from_file(WORDS)
    want = sorted([*library.encode(r["text"] or "", add_special_tokens=False).ids, 1] for r in docs.collect())
    rows = packing.packed_pieces(docs, WORDS).collect()
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append(r)
    padding = 0
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= packing.WINDOW
        padding += 0 if at & (at - 1) == 0 else packing.WINDOW - at
    assert sorted(sequences) == list(range(len(sequences)))
    total = sum(map(len, want))
    assert sum(r["length"] for r in rows) == total
    assert which == "odd_docs" or padding < 0.02 * total + packing.WINDOW
    if which == "documents":
        ids = {r["doc_id"]: [*library.encode(r["text"], add_special_tokens=False).ids, 1] for r in docs.collect()}
        for r in rows:
            piece = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
            assert len(piece) == r["length"] and r["doc_tokens"] == len(ids[r["doc_id"]]) and r["ids_crc32"] == zlib.crc32(np.array(piece, "<u4").tobytes())


def test_packing_nothing(no_docs):
    assert packing.packed_pieces(no_docs, WORDS).count() == 0
