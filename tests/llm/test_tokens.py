import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from feedloom.llm import bpe, merges, tokenfiles
from feedloom.llm.common import new_path

WORD, BYTE = (public_tokenizers.path(f"{n}.json") for n in ("word_bpe_49k", "byte_bpe_50k"))
PARTS = list(" \n\t\r  \x1c\x85　abcXYZ'sé1٣²½.,!?|;:-́İΣς漢😀­﻿\x00_<>") + [
    "<|endoftext|>", "'s", "'ll", " the", "<|startoftext|>", "The", "<|ENDOFTEXT|>", "don't", "  ", "\n\n",
]


def texts(seed, n):
    draw = random.Random(seed)
    return ["".join(draw.choices(PARTS, k=draw.randint(0, 14))) for _ in range(n)]


def test_word_encoder_equals_the_library(monkeypatch):
    monkeypatch.setattr(tokenfiles, "CACHE_WORDS", 50)
    library, own = Tokenizer.from_file(WORD), tokenfiles.WordEncoder(WORD, 2)
    for k in range(0, 4000, 8):
        batch = texts(k, 8)
        for text, ids in zip(batch, own.encode(batch)):
            assert np.frombuffer(ids, "<u2").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_words_are_encoded_once_beside_odd_white_space(monkeypatch):
    """Double spaces and tabs hinder cuts only where they stand; each distinct word of a batch is encoded once."""
    seen, plain = [], bpe.encode_words
    monkeypatch.setattr(bpe, "encode_words", lambda path, words: seen.extend(words) or plain(path, words))
    draw = random.Random(3)
    batch = ["\n".join(draw.choices(["ab", "cde", "fgh."], k=300)) + "  odd\tend" for _ in range(5)] + ["", "\n"]
    library = Tokenizer.from_file(BYTE)
    for text, row in zip(batch, bpe._Words(BYTE, {}).look_up(batch), strict=True):
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(b"".join(i for i, _ in row), "<u4").tolist() == ids
    assert sum(map(len, seen)) < 100


def test_word_table_equals_the_library(monkeypatch):
    monkeypatch.setattr(bpe, "OWN_WORDS", 50)
    library, own = Tokenizer.from_file(BYTE), bpe._Words(BYTE, {})
    for k in range(0, 4000, 8):
        batch = texts(k, 8)
        for text, row in zip(batch, own.look_up(batch)):
            ids = library.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(b"".join(i for i, _ in row), "<u4").tolist() == ids, repr(text)
            assert b"".join(p for _, p in row).decode("utf-8", "replace") == library.decode(ids, skip_special_tokens=False)


def test_a_task_holds_little_at_once(monkeypatch):
    """The library gets some words at a time and a task's texts go through in blocks, with the ids of one call."""
    sizes, plain = [], bpe._tokenizer(BYTE)

    class Counting:
        def encode_batch(self, words, **options):
            sizes.append(len(words))
            return plain.encode_batch(words, **options)

    monkeypatch.setattr(bpe, "_tokenizer", lambda path: Counting())
    words = [f" {k}x" if k % 5 else "x" * (k % 7) for k in range(9000)]
    ids, bounds = bpe.encode_words(BYTE, [w.encode() for w in words])
    assert max(sizes) <= 2000 and sum(sizes) >= 7000
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [e.ids for e in plain.encode_batch(words, add_special_tokens=False)]
    assert bpe.encode_words(BYTE, [])[1].tolist() == [0]

    rows = ["ab", "", "c" * 9, "", "de", "f"]
    cut = list(bpe.blocks(rows, 4))
    assert sum(cut, []) == rows and all(len(b) == 1 or len("".join(b)) <= 4 for b in cut) and list(bpe.blocks([])) == []


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_merges_equal_the_library(path):
    """Words of letters of several scripts, as whole texts of the library."""
    draw, library = random.Random(8), Tokenizer.from_file(path)
    letters = "aeioubcdfghklmnprstvwyz" * 3 + "àéüßñçöæøåªºµ" + ("" if path == WORD else "AEXYZİŁžαωΣжяЖ")
    words = list({"".join(draw.choices(letters, k=draw.randint(1, 16))) for _ in range(6000)})
    words = words if path == WORD else [draw.choice(["", " "]) + w for w in words]
    assert all(merges.is_letters(w.strip()) for w in words)
    for word, ids in zip(words, merges.merges_of(path).encode_all([w.encode() for w in words])):
        assert ids.tolist() == library.encode(word, add_special_tokens=False).ids, word
    assert merges.merges_of(path).encode_all([]) == []


def test_shards_follow_the_text(spark, docs, monkeypatch):
    monkeypatch.setattr(tokenfiles, "SHARD_BYTES", 2000)
    rows = {k: f"word{k} " * 50 for k in range(100)}
    folder = new_path(spark, "tokens")
    tokenfiles.write_tokens(docs(*rows.items()), folder, WORD, 2)
    shards = tokenfiles.shard_bases(spark, folder).collect()
    assert len(shards) > 12 and tokenfiles.read_tokens(spark, folder, 2).count() == 100


@pytest.mark.parametrize("limit", [0, 3, 10_000])
def test_encode_decode(docs, limit):
    library = Tokenizer.from_file(BYTE)
    rows = dict(enumerate(["the cat, the dog.\nthe end", "", "  two  spaces ", *texts(5, 30)]))
    got = {r["doc_id"]: r for r in bpe.encode_decode(docs(*rows.items()), BYTE, table_words=limit).collect()}
    for i, text in rows.items():
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(got[i]["ids"], "<u4").tolist() == ids
        assert got[i]["decoded"] == library.decode(ids, skip_special_tokens=False)


def test_files_round_trip(spark, docs):
    library = Tokenizer.from_file(WORD)
    rows = {9 * k: t for k, t in enumerate(texts(6, 60))}
    folder = new_path(spark, "tokens")
    tokenfiles.write_tokens(docs(*rows.items()), folder, WORD, 2, shards=4)
    got = {r["doc_id"]: r for r in tokenfiles.read_tokens(spark, folder, 2).collect()}
    start = 0
    for i in sorted(rows):
        ids = library.encode(rows[i], add_special_tokens=False).ids + [2]
        assert (got[i]["start"], np.frombuffer(got[i]["ids"], "<u4").tolist()) == (start, ids)
        start += len(ids)


def test_shards_map_into_memory(spark, docs):
    import pathlib

    folder = new_path(spark, "tokens")
    tokenfiles.write_tokens(docs((1, "one two"), (2, ""), (3, "three")), folder, WORD, 2, shards=2)
    seen = {}
    for path in sorted(pathlib.Path(folder.removeprefix("file:")).glob("part-*")):
        ids, numbers, offsets = tokenfiles.open_shard(str(path), 2)
        for number, a, b in zip(numbers.tolist(), offsets[:-1].tolist(), offsets[1:].tolist()):
            seen[number] = ids[a:b].tolist()
    assert seen[2] == [2] and all(ids[-1] == 2 for ids in seen.values()) and set(seen) == {1, 2, 3}


def test_width():
    assert tokenfiles.id_width(50_000, 2) == 2 and tokenfiles.id_width(70_000, 2) == 4 and tokenfiles.id_width(50_000, 300) == 4
    with pytest.raises(ValueError):
        tokenfiles.id_width(10, 2**24)


def test_odd_rows(spark, odd_docs, no_docs):
    folder, empty = new_path(spark, "tokens"), new_path(spark, "tokens")
    tokenfiles.write_tokens(odd_docs, folder, WORD, 2, shards=3)
    rows = tokenfiles.read_tokens(spark, folder, 2).orderBy("start").collect()
    assert len(rows) == 13 and [r["doc_id"] for r in rows[:2]] == [None, None]
    assert [r["doc_id"] for r in rows[2:]] == sorted(r["doc_id"] for r in rows[2:])
    assert bpe.encode_decode(odd_docs, BYTE).count() == 13
    assert bpe.encode_decode(no_docs, BYTE).count() == 0
    tokenfiles.write_tokens(no_docs, empty, WORD, 2)
    assert tokenfiles.read_tokens(spark, empty, 2).count() == 0
