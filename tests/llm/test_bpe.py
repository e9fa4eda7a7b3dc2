"""BPE encoding and decoding against the library that the vocabulary files are made for."""

import hashlib
import json
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer, models

from winnow.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None,
    "",
    " \t\n　",
    "The quick brown fox, it's 42 don't!",
    "the quick brown fox, it's 42 don't!",
    "<|endoftext|>a<|startoftext|><|endoftext|> <|endoftex t|>x<|endoftext|",
    "ΟΔΟΣ Οδός İstanbul ǅ ſ ẞ ﬁ Ⅷ ½ é 한 ́x",
    "a\x1cb\x1d c\x00d\x85e f​g﻿h",
    "日本語のテキスト 한국어 😀👍🏽 𐐀𐐨 \U0010ffff",
    "x" * 20_000 + " " + "日本" * 3_000 + "1" * 500 + "!" * 5_000,
    "word " * 30_000,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_ids_and_texts_like_the_library(spark, docs_of, library, monkeypatch):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (None, "no id")]
    docs = docs_of(rows, extra=True)
    got = bpe.decode(bpe.encode(docs, PATH), PATH)
    assert got.columns == [*docs.columns, "ids", "decoded"]
    ids = [(t, library.encode(t or "", add_special_tokens=False).ids) for _, t in rows]
    want = sorted((t or "", i, library.decode(i, skip_special_tokens=False)) for t, i in ids)
    assert sorted((r.text or "", r.ids, r.decoded) for r in got.collect()) == want
    once = bpe.encode(docs, PATH, keep=["text"], decoded="back")
    assert once.columns == ["text", "ids", "back"]
    assert sorted((r.text or "", r.ids, r.back) for r in once.collect()) == want
    digests = {r.doc_id: r for r in bpe.digests(docs, PATH).collect()}
    assert digests[0].n_tokens == 0 and digests[0].ids_sha256 == hashlib.sha256(b"").hexdigest()
    text = " ".join(map(str, ids[4][1]))
    assert digests[4].ids_sha256 == hashlib.sha256(text.encode()).hexdigest()
    codec = bpe.Codec.of(open(PATH).read())
    monkeypatch.setattr(bpe, "_SLICE_CHARS", 7)
    monkeypatch.setattr(bpe, "_BLOCK_IDS", 3)
    monkeypatch.setattr(bpe, "_CACHED", 2)
    assert [x.tolist() for x in codec.encode_all([t or "" for t, _ in ids])] == [i for _, i in ids]
    for text, i in ids:
        assert codec.encode(text or "").tolist() == i
        assert codec.decode(np.array(i, np.int32)) == library.decode(i, skip_special_tokens=False)


def test_every_code_point_like_the_library(library):
    codec = bpe.Codec.of(open(PATH).read())
    points = [c for c in range(0x3200) if not 0xD800 <= c < 0xE000] + list(range(0xF900, 0x10000, 7)) + list(range(0x10000, 0x20000, 53))
    texts = [f"a{chr(c)}b1{chr(c)}{chr(c)} {chr(c)}" for c in points]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert codec.encode(text).tolist() == want.ids, ascii(text)


def merges_over(draw, letters, count):
    """A random merge list in which every part is made before it is used, and its vocabulary."""
    vocab = {t: i for i, t in enumerate([*letters, *[f"{c}$" for c in letters]])}
    merges = []
    while len(merges) < count:
        left, right = draw.choice(list(vocab)), draw.choice(list(vocab))
        if "$" not in left and left + right not in vocab and len(left + right) < 12:
            vocab[left + right] = len(vocab)
            merges.append((left, right))
    return vocab, merges


@pytest.mark.parametrize("seed", range(40))
def test_stable_tokens_are_those_of_the_whole_word(seed):
    draw = random.Random(seed)
    letters = "ab" if seed % 2 else "abc"
    vocab, merges = merges_over(draw, letters, draw.randint(1, 40))
    library = models.BPE(vocab, merges, end_of_word_suffix="$")
    list_ = bpe.Merges(vocab, merges, "$")
    size = {i: len(t.rstrip("$")) for t, i in vocab.items()}
    machine = bpe.Transducer(list_, {c: vocab[c] for c in letters}, {c: vocab[c + "$"] for c in letters}, size)
    # as little as the lookahead allows, so that every token is put out as early as it may be
    machine.window = list_.lookahead + list_.longest + 2
    for length in (1, 2, 5, 300):
        word = "".join(draw.choices(letters, k=length))
        assert list(machine.word(word)) == [t.id for t in library.tokenize(word)]
    assert list(machine.word("")) == []
    words = ["".join(draw.choices(letters, k=draw.randint(1, 64))) for _ in range(60)]
    table = bpe.Table(list_, {c: vocab[c] for c in letters}, {c: vocab[c + "$"] for c in letters})
    flat, counts = table.apply(words)
    assert [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])] == [[t.id for t in library.tokenize(w)] for w in words]
    assert len(table.apply([])[0]) == 0


def test_lookahead_is_the_heaviest_chain():
    vocab = {t: i for i, t in enumerate(["a", "b", "c", "ab", "ca", "bc"])}
    # b with c, then a with b: what follows b decides whether a keeps its place
    assert bpe.Merges(vocab, [("b", "c"), ("a", "b")], "").lookahead == 2
    assert bpe.Merges(vocab, [("a", "b"), ("b", "c")], "").lookahead == 1
    with pytest.raises(ValueError):
        bpe.Merges(vocab, [("a", "b"), ("a", "b")], "")


def test_bytes_to_text_at_any_cut():
    whole = "aé日😀z".encode() + b"\xe6\x97" + b"\xff\xf0\x9f" + "ü".encode() + b"\xc3"
    for size in range(1, 9):
        machine = bpe.ByteToText()
        parts = [machine.feed(whole[i : i + size]) for i in range(0, len(whole), size)]
        assert "".join(parts) + machine.finish() == whole.decode("utf-8", "replace")


def test_byte_level_decoder(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    lists = [library.encode(t or "", add_special_tokens=False).ids for t in TEXTS] + [None, [50256, 10]]
    table = spark.createDataFrame([(i, x, "old") for i, x in enumerate(lists)], "doc_id long, ids array<int>, decoded string")
    got = {r.doc_id: r.decoded for r in bpe.decode(table, path).collect()}
    assert got == {i: library.decode(x or [], skip_special_tokens=False) for i, x in enumerate(lists)}
    with pytest.raises(ValueError):
        bpe.encode(table.withColumnRenamed("decoded", "text"), path)


def test_files_that_are_not_plain(tmp_path, spark, docs_of):
    content = json.load(open(PATH))
    content["model"]["type"] = "WordPiece"
    path = tmp_path / "other.json"
    path.write_text(json.dumps(content))
    with pytest.raises(ValueError):
        bpe.encode(docs_of([(1, "a")]), str(path))
    assert bpe.digests(docs_of([]), PATH).count() == 0


def test_bytes_that_are_no_text(spark, docs_of, library):
    broken = docs_of([(1, "x")]).selectExpr("doc_id", "cast(X'6120FF62' as string) as text")
    assert bpe.encode(broken, PATH).first().ids == library.encode("a �b", add_special_tokens=False).ids
