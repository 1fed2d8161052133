import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from logloom.llm import tokens, transducer
from pyspark.sql import functions as F

public = pytest.importorskip("public_tokenizers")
RAW = open(tokens.vocabulary_path(), "rb").read()
MACHINE = transducer.Transducer(transducer.Vocabulary(RAW))
EDGES = [
    "", "a", " ", "  ", "\n", "\n\n", " \n a", "it's", "it's's", "'s", "!'s", " 's", "\n's", "'sam we'll they've I'M", "x'", "x''s", "'''s",
    "a b", "　　x", "日本語 テキスト", "😀😀 ok", "é" * 50, " " * 100 + "x", "\t\tx", "12ab34", "<|endoftext|>", "a\r\n\r\nb", "'re're",
    "s'd ", "́a", "'l", "'ll", "'r 'v", "''ll", "\x00\x01", " '", "\n'", "\n 've", "１２³½", "a" * 3000, "----" * 500, "x 's", "﻿1\n",
]


def run(machine, texts):
    data = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)
    ids, counts = machine.encode(np.frombuffer(b"".join(data), np.uint8), offsets[1:])
    assert machine.count(np.frombuffer(b"".join(data), np.uint8), offsets[1:]).tolist() == counts.tolist()
    ends = np.cumsum(counts)
    return [ids[e - n : e].tolist() for e, n in zip(ends, counts, strict=True)]


def public_ids(texts):
    t = pytest.importorskip("tokenizers").Tokenizer.from_file(tokens.vocabulary_path())
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_edges_are_as_the_public_tokenizer_has_them():
    assert run(MACHINE, EDGES) == public_ids(EDGES)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(list("ab 's\n\t.,!1LlétT—日😀")), st.characters(codec="utf-8", max_codepoint=0x2FFFF, exclude_categories=["Cn", "Cs"])), max_size=60), max_size=6))
def test_any_texts(texts):
    assert run(MACHINE, texts) == public_ids(texts)


def test_states_made_anew_and_lanes_of_any_size(monkeypatch):
    rnd = random.Random(4)
    texts = ["".join(rnd.choice(["the ", "Xq", "\n", "été", " 12", "'ll", "zzz"]) for _ in range(rnd.randrange(200))) for _ in range(40)]
    expected = public_ids(texts)
    monkeypatch.setattr(transducer, "LANE", 5)
    assert run(transducer.Transducer(MACHINE.v, max_states=3), texts) == expected
    # Within one run too the table is made anew, with only the states that lanes are in.
    small, made = transducer.Transducer(MACHINE.v, max_states=1), []
    restart = small._restart
    monkeypatch.setattr(small, "_restart", lambda state: made.append(len(small.readings)) or restart(state))
    monkeypatch.setattr(transducer, "LANE", 10_000)
    assert run(small, texts) == expected and made
    assert [i for t in texts for i in run(MACHINE, [t])[0]] == [i for e in expected for i in e]


def test_neighbours_agree_if_the_merges_make_them():
    rnd = random.Random(2)
    v = MACHINE.v

    def merged(data):
        at = [v.of_byte[b] for b in data]
        while True:
            ranks = [(v.merge(*p)[0], i) for i, p in enumerate(zip(at, at[1:])) if v.merge(*p)]
            if not ranks:
                return at
            _, i = min(ranks)
            at[i : i + 2] = [v.merge(at[i], at[i + 1])[1]]

    some = rnd.sample(sorted(v.bytes), 250)
    assert all(v.whole(t) == (merged(v.bytes[t]) == [t]) for t in some)
    pairs = list(zip(some, reversed(some))) + [(t, t) for t in some]
    assert all(v.agree(a, b) == (merged(v.bytes[a] + v.bytes[b]) == [a, b]) for a, b in pairs if v.whole(a) and v.whole(b))


def test_long_texts_are_handled_in_parts(monkeypatch):
    rnd = random.Random(6)
    words = ["the", " big", "\n", "\n\n", " ", "  ", "00:01:02,345", "été", "'ll", "it's ", "日本", ".", "\r\n", "x1 "]
    texts = ["".join(rnd.choice(words) for _ in range(rnd.choice([0, 5, 900]))) for _ in range(25)] + ["日本" * 400, "", "a b"]
    monkeypatch.setattr(transducer.cut_long, "__defaults__", (64,))
    monkeypatch.setattr(transducer.chunks, "__defaults__", (100,))
    ends = np.cumsum([len(t.encode()) for t in texts])
    cuts, of = transducer.cut_long(np.frombuffer("".join(texts).encode(), np.uint8), ends)
    assert len(cuts) > 200 and np.all(np.diff(cuts) >= 0) and np.all(np.diff(of) >= 0) and set(of.tolist()) == set(range(len(texts)))
    assert run(MACHINE, texts) == public_ids(texts)


def test_rank_files():
    import base64

    tiktoken = pytest.importorskip("tiktoken")
    path = tokens.vocabulary_path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    known = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    machine = transducer.Transducer(transducer.Vocabulary(open(path, "rb").read()))
    texts = EDGES + ["Привет, как дела? Хорошо!\n", "Où est la bibliothèque ? Là-bas.", "ニュースを見た。\n\n「はい」"]
    assert run(machine, texts) == [known.encode_ordinary(t) for t in texts]
    text = "".join(texts)
    d = transducer.StreamDecoder(machine.v.bytes)
    assert d.push(run(machine, [text])[0]) + d.close() == text


def test_streams_decode_in_any_pieces():
    text = "naïve 日本語 😀 'll\r\n"
    ids = run(MACHINE, [text])[0]
    for step in range(1, len(ids) + 1):
        d = transducer.StreamDecoder(MACHINE.v.bytes)
        assert "".join(d.push(ids[i : i + step]) for i in range(0, len(ids), step)) + d.close() == text
    d = transducer.StreamDecoder(MACHINE.v.bytes)
    assert d.push([MACHINE.v.of_byte[0xE2]]) == "" and d.push([MACHINE.v.of_byte[0x41]]) == "�A"
    assert d.push([MACHINE.v.of_byte[0xF0]]) + d.close() == "�"


def test_what_is_remembered_is_bounded():
    v = transducer.Vocabulary(RAW)
    machine = transducer.Transducer(v, max_states=40)
    for i in range(30):
        run(machine, [f"some other words {i * 7919} of 'many" * 3])
    assert v.known() <= 8 * 40 + 2000 and len(machine.readings) <= 2000
    before = v.known()
    machine._clear()
    assert before and v.known() == 0


def test_documents(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "word " * 40_000), (5, "ends é"), (5, "ends é"), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"ids": F.lit("clash"), "n_tokens": F.lit(0)})
    got = sorted(((r["doc_id"] or 0, list(r["ids"])) for r in tokens.encode(docs).collect()), key=repr)
    expected = sorted(((i or 0, public_ids([t or ""])[0]) for i, t in rows), key=repr)
    assert got == expected
    counts = sorted((r["doc_id"] or 0, r["n_tokens"]) for r in tokens.count(docs).collect())
    assert counts == sorted((i, len(ids)) for i, ids in expected)
    back = tokens.decode(tokens.encode(docs), step=3).collect()
    assert sorted(((r["doc_id"] or 0, r["text"]) for r in back), key=repr) == sorted(((i or 0, t or "") for i, t in rows), key=repr)
    assert tokens.encode(docs.limit(0)).count() == 0
