"""Tokens, leaks and personal information."""

import random

import pytest

from quiverlake.llm import bpe, leakage, pii, pii_train, tokens
from quiverlake.session import table

PATH = tokens.vocabulary_path()


# ------------------------------------------------------------ tokens
@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(PATH)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return t


HARD = ["", " ", "  a", "it's I'll WE'D", "<|endoftext|>", "\n\n\t x", "中文 测试，混合 text", "é́ ﬁ ½ Ⅷ", "🙂🙃 ⚠️", "​﻿\x00", "a" * 3000, "-" * 5000, "中" * 2000, " " * 1500 + "x", "aé" * 900, "0123456789" * 300, "ÿþ\x7f"]


def test_same_ids_as_the_library(encoder, library, spark, data):
    r = random.Random(1)
    texts = HARD + ["".join(r.choice("abcdeé中文 \n01'st<|>") for _ in range(r.randint(0, 200))) for _ in range(1500)]
    texts += [x["text"] for x in table(spark, data, "documents").select("text").collect() if x["text"]]
    for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert encoder.encode(t) == e.ids, t[:80]


def test_other_vocabulary(encoder):
    import base64

    import tiktoken

    path = tokens.vocabulary_path("byte_bpe_multi_50k")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    ref = tiktoken.Encoding("own", pat_str=bpe.SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})
    mine = bpe.Encoder(path)
    for t in HARD:
        assert mine.encode(t) == ref.encode_ordinary(t)


def test_tables_may_start_anew(library):
    small = bpe.Encoder(PATH)
    small.transducer.max_states, small.transducer.max_pieces = 50, 10
    texts = ["some words here", "other words there and more of them", "中文测试"] * 5
    assert [small.encode(t) for t in texts] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_settled_blocks_do_not_change_ids(encoder):
    piece = ("abcabca" * 2000).encode()
    assert encoder.transducer.encode_piece(piece, block=256) == encoder.transducer.encode_piece(piece, block=1 << 30)


def test_decoding(encoder):
    spelling = encoder.transducer.spelling
    for t in HARD:
        assert "".join(bpe.decode_stream(encoder.encode(t), spelling)) == t
    with pytest.raises(KeyError):
        list(bpe.decode_stream([10**6], spelling))


@pytest.mark.parametrize("data_", [b"\xc3", b"\xff", b"\xe4\xb8", b"a\xc3(", b"\xed\xa0\x80", b"\xf0\x9f\x99\x82", b"\xf4\x90\x80\x80", b"\xe0\x80\xaf", b"\xc0\xaf", b"\xf0\x9fA"])
def test_utf8_by_bytes_equals_the_decoder(data_):
    s = bpe.Utf8Stream()
    assert "".join(s.feed(bytes((b,))) for b in data_) + s.close() == data_.decode("utf-8", "replace")


def test_encoding_operator(spark, encoder):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "hi there", "z"), (3, "hi there", "z"), (None, "a", "q")], "doc_id bigint, text string, ids string")
    got = sorted(((r["doc_id"] or 0, r["ids"]) for r in tokens.encode(docs).collect()), key=str)
    hi = encoder.encode("hi there")
    assert got == sorted([(1, []), (2, []), (3, hi), (3, hi), (0, encoder.encode("a"))], key=str)
    assert tokens.encode(docs.limit(0)).count() == 0
    back = {r["doc_id"]: r["text"] for r in tokens.decode(tokens.encode(docs)).collect()}
    assert back == {1: "", 2: "", 3: "hi there", None: "a"}


# ------------------------------------------------------------ leaks
def overlaps(docs, items):
    grams = {}
    for i, t in items:
        u = leakage.units(t)
        for k in range(len(u) - 11):
            grams.setdefault(tuple(u[k : k + 12]), set()).add(i)
    out = set()
    for d, t in docs:
        u = leakage.units(t)
        for k in range(len(u) - 11):
            out |= {(d, i) for i in grams.get(tuple(u[k : k + 12]), ())}
    return out


def run(spark, docs, items, **kw):
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    i = spark.createDataFrame(items, "item_id bigint, text string")
    return {tuple(r) for r in leakage.leaks(d, i, **kw).collect()}


def test_units():
    assert leakage.units("Ｈello, WORLD-1 中文x²") == ["hello", "world", "1", "中", "文", "x2"]
    assert leakage.units(None) == leakage.units("") == leakage.units("—") == []


def test_leaks_of_the_table(spark, data):
    docs, items = table(spark, data, "documents"), table(spark, data, "eval_items")
    want = overlaps([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    assert {tuple(r) for r in leakage.leaks(docs, items).collect()} == want and want


def test_leaks_at_every_place_and_length(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(r.choices(words, k=r.randint(5, 60)))) for i in range(30)]
    docs = []
    for n in range(150):
        i, t = r.choice(items)
        u = t.split()
        k = r.randint(0, max(0, len(u) - 10))
        piece = u[k : k + r.choice((10, 11, 12, 13, 20))]
        docs.append((n, " ".join(r.choices(words, k=r.randint(0, 40)) + [w.upper() for w in piece] + r.choices(words + ["zz"], k=r.randint(0, 40)))))
    docs += [(900, None), (901, ""), (902, items[0][1] * 3), (903, "x " * 20000 + items[1][1])]
    want = overlaps(docs, items)
    assert run(spark, docs, items) == want and len(want) > 50
    assert run(spark, docs, items, settings=leakage.Settings(items_at_once=7, rank=64)) == want


def test_leak_edges(spark):
    assert run(spark, [(1, "a b c")], [(1, "a b c d")]) == set()
    text = " ".join(f"t{i}" for i in range(12))
    assert run(spark, [(1, text), (1, text), (2, text[:-4])], [(7, text), (8, None), (9, text)]) == {(1, 7), (1, 9)}
    assert run(spark, [], [(7, text)]) == set() and run(spark, [(1, text)], []) == set()


def test_paraphrases(spark):
    item = "the old harbour office keeps thirteen glyph outlines in seven sealed boxes and names the last drawer answer 4711"
    near = "the old harbour office keeps the thirteen glyph outlines in seven well sealed boxes and also names last drawer 4711"
    d = spark.createDataFrame([(1, near), (2, item), (3, "nothing of the kind stands here")], "doc_id bigint, text string")
    i = spark.createDataFrame([(5, item)], "item_id bigint, text string")
    got = leakage.paraphrases(d, i).collect()
    assert [(r["doc_id"], r["item_id"]) for r in got] == [(1, 5)] and got[0]["lcs"] >= 12 and got[0]["answers"] == 1
    assert leakage.common_run(list("abcde"), list("xbcdy")) == 3
