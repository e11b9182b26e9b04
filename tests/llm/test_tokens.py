import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pixelflow.llm import bpe, bpe_codec, packing, queries, token_counts, training_order
from tests.llm.conftest import ROWS

tokenizers = pytest.importorskip("tokenizers")
BYTE, WORD = queries.tokenizer("byte_bpe_50k.json"), queries.tokenizer("word_bpe_49k.json")
byte, word = tokenizers.Tokenizer.from_file(BYTE), tokenizers.Tokenizer.from_file(WORD)
TEXT = st.text(st.sampled_from(list("aAbBéÉ  \n\t'sdmreİΣß中1٣①_#|<>.!́\xa0​ \x1c\x85\r🙂")), max_size=80)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_equal_to_the_library(text):
    ids = word.encode(text, add_special_tokens=False).ids
    assert token_counts.counter(BYTE).count(text) == len(byte.encode(text, add_special_tokens=False).ids)
    c = bpe_codec.codec(WORD)
    assert c.encode(text) == ids and c.text(ids) == word.decode(ids, skip_special_tokens=False)
    assert np.frombuffer(packing.library_ids(WORD).encode_bytes(text), "<u4").tolist() == ids
    assert c.digest(text) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(c.text(ids).encode()).hexdigest())
    t = training_order.tokens(queries.tokenizer("byte_bpe_50k.tiktoken"))
    assert np.frombuffer(t.encode(text), "<u2").tolist() == [*t.library.encode_ordinary(text), t.end]


def test_training_order_encodes_a_text_by_one_call():
    t, calls = training_order.Tokens(queries.tokenizer("byte_bpe_50k.tiktoken")), []
    library = t.library

    class Counted:
        def encode_ordinary(self, text):
            calls.append(text)
            return library.encode_ordinary(text)

    t.library = Counted()
    texts = ["one word\nand one more", "  uneven \t blanks ", ""]
    assert [np.frombuffer(t.encode(x), "<u2").tolist() for x in texts] == [[*library.encode_ordinary(x), t.end] for x in texts] and calls == texts


def test_special_strings_and_long_words():
    for text in ("a<|endoftext|> b <|startoftext|>c", "ab" * 5000):
        assert token_counts.counter(BYTE).count(text) == len(byte.encode(text, add_special_tokens=False).ids)
        assert bpe_codec.codec(WORD).encode(text) == word.encode(text, add_special_tokens=False).ids


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    p = bpe.Pieces(len)
    assert [p[x] for x in ("a", "bb", "ccc", "dddd", "a", "e" * 99)] == [1, 2, 3, 4, 1, 99] and len(p) <= 3


def test_counts_and_codec_over_rows(docs, none):
    got = {(r.doc_id, r.n_bytes): (r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs, BYTE).collect()}
    for k, text, _, _ in ROWS:
        n = len(byte.encode(text or "", add_special_tokens=False).ids)
        assert got[k, len((text or "").encode())] == (n, n > 512)
    encoded = bpe_codec.encode(docs, WORD)
    back = {r.doc_id: r.text for r in bpe_codec.decode(encoded, WORD).collect()}
    assert all(back[k] == word.decode(word.encode(text or "", add_special_tokens=False).ids, skip_special_tokens=False) for k, text, _, _ in ROWS)
    assert bpe_codec.digest(docs, WORD).count() == len(ROWS)
    assert token_counts.count_tokens(none, BYTE).collect() == bpe_codec.digest(none, WORD).collect() == []


def test_packing_covers_every_id_once(docs, none):
    pieces = packing.pack(docs.filter("doc_id != 6"), WORD).collect()
    texts = {k: text for k, text, _, _ in ROWS}
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
    for k, found in by_doc.items():
        ids = np.array([*word.encode(texts[k] or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for p in sorted(found, key=lambda p: p.start):
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + p.length].tobytes()))
            at += p.length
        assert at == len(ids)
    for found in by_seq.values():
        at = 0
        for p in sorted(found, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
    assert by_doc.keys() == texts.keys() - {6} and packing.pack(none, WORD).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 7), st.integers(0, 9)), min_size=1, max_size=10))
def test_plan_is_optimal(steps):
    cuts, pens = [0], [0.0]
    for gap, pen in steps:
        cuts.append(cuts[-1] + gap)
        pens.append(float(pen))
    size = 8
    pad = lambda n: 0 if n & (n - 1) == 0 else size - n
    best = [0.0] + [np.inf] * (len(cuts) - 1)
    for j in range(1, len(cuts)):
        best[j] = min(best[i] + pad(cuts[j] - cuts[i]) + pens[j] for i in range(j) if cuts[j] - cuts[i] <= size)
    chain = packing.plan(cuts, pens, size)
    cost = sum(pad(cuts[b] - cuts[a]) + pens[b] for a, b in zip(chain, chain[1:]))
    assert chain[0] == 0 and chain[-1] == len(cuts) - 1 and cost == pytest.approx(best[-1])


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000])
def test_permutation_is_a_bijection(n):
    p = training_order.Permutation(n, 99)
    slots = p.slot(np.arange(n))
    assert sorted(slots) == list(range(n)) and (p.index(slots) == np.arange(n)).all()


def test_shards_hold_every_sequence_at_its_slot(docs, none):
    path = queries.tokenizer("byte_bpe_50k.tiktoken")
    rows = training_order.shards(docs, path, 5, length=64, per_shard=16)
    got = rows.orderBy("first_slot").collect()
    t = training_order.tokens(path)
    raw = [(k, t.encode(text)) for k, text, _, _ in ROWS]
    want = sorted((k, at // 128, x[at : at + 128]) for k, x in raw for at in range(0, len(x), 128))
    have, at = [], 0
    for r in got:
        assert (r.shard, r.first_slot, r.stride, len(r.payload), zlib.crc32(r.payload)) == (at // 16, at, 128, r.n_slots * 128, r.crc32)
        have += [(d, p, bytes(r.payload[k * 128 : k * 128 + 2 * n])) for k, (d, p, n) in enumerate(zip(r.doc_ids, r.parts, r.n_ids))]
        at += r.n_slots
    assert sorted(have) == want
    read = training_order.read(rows, 10, 20)
    assert [s for s, _ in read] == list(range(10, 30)) and read[0][1].tobytes() == got[0].payload[10 * 128 : 11 * 128]
    assert training_order.shards(none, path, 5).collect() == []
