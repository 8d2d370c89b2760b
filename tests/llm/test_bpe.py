import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelmill.llm.bpe import Encoder, encode_texts
from panelmill.llm.queries import VOCABULARY

pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary file")


@pytest.fixture(scope="module")
def ours():
    return Encoder(VOCABULARY)


@pytest.fixture(scope="module")
def public():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


ODD = [
    "", " ", "\n\n \t x", "<|endoftext|>", "don't I'll we've it's'd", "a" * 5000, " " * 3000 + "x", "\x00\x1c\x1f\x85\xa0 　",
    "½²Ⅷ 漢字 😀‍👩 é é", "\\frac{a}{b} $x^2$ % c\r\n", "ab" * 96, "ab" * 96 + "c", "漢字仮名" * 900, "".join(chr(97 + i * i % 23) for i in range(9000)), "ABCDEFGHIJ" * 700, "﻿x​",
]


def test_odd_texts(ours, public):
    for text in ODD:
        assert ours.encode([text])[0].tolist() == public(text), text[:40]


@given(st.text(max_size=80))
@settings(max_examples=150, deadline=None)
def test_any_text(ours, public, text):
    assert ours.encode([text])[0].tolist() == public(text)


def one_by_one(vocabulary, raw):
    """The definition: contract the leftmost pair of least rank until there is none."""
    pairs = {(a, b): (rank, merged) for a, b, rank, merged in vocabulary.merges}
    tok = [int(vocabulary.byte_ids[x]) for x in raw]
    while found := [(pairs[p][0], i) for i, p in enumerate(zip(tok, tok[1:])) if p in pairs]:
        _, i = min(found)
        tok[i : i + 2] = [pairs[tok[i], tok[i + 1]][1]]
    return tok


@given(st.text("aabcn \u00fc\u6f22", min_size=1, max_size=400))
@settings(max_examples=60, deadline=None)
def test_recursion_contracts_one_by_one(ours, word):
    assert list(memoryview(dict(ours._contract([word.encode()]))[0]).cast("i")) == one_by_one(ours.vocabulary, word.encode())


def test_instalments_change_nothing(ours, monkeypatch):
    from panelmill.llm import bpe

    words = ["tokenization" * 40, "ab" * 300, "x", "漢字" * 50]
    raw = [w.encode() for w in words]
    whole = dict(ours._contract(raw))
    monkeypatch.setattr(bpe, "HELD_ROWS", 10)
    assert dict(ours._contract(raw)) == whole


def test_vocabulary_out_of_order_is_refused(tmp_path):
    import json

    from panelmill.llm.bpe import Vocabulary, byte_alphabet

    vocab = {c: i for i, c in enumerate(byte_alphabet())} | {"ab": 256, "abc": 257}
    for merges, good in ((["a b", "ab c"], True), (["ab c", "a b"], False)):
        (tmp_path / "v.json").write_text(json.dumps({"model": {"vocab": vocab, "merges": merges}}))
        if good:
            assert len(Vocabulary(str(tmp_path / "v.json")).merges) == 2
        else:
            with pytest.raises(ValueError, match="order"):
                Vocabulary(str(tmp_path / "v.json"))


def test_round_trip(ours):
    import json

    from panelmill.llm.bpe import byte_alphabet

    alphabet = byte_alphabet()
    names = {i: bytes(alphabet[c] for c in t) for t, i in json.load(open(VOCABULARY))["model"]["vocab"].items() if all(c in alphabet for c in t)}
    for text in ODD:
        assert b"".join(names[i] for i in ours.encode([text])[0].tolist()).decode() == text


def test_table(spark, public):
    rows = [(1, "Hello world", "clash"), (1, "Hello world", "clash"), (2, None, None), (None, "x", ""), (3, "", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(((r["doc_id"] or 0, r["ids"]) for r in encode_texts(df, VOCABULARY).collect()))
    assert got == [(0, public("x")), (1, public("Hello world")), (1, public("Hello world")), (2, []), (3, [])]
    assert sorted(r["n_tokens"] for r in encode_texts(df, VOCABULARY, counts_only=True).collect()) == [0, 0, 1, 2, 2]
    assert encode_texts(df.limit(0), VOCABULARY).count() == 0
