"""Token counts and byte-level BPE against the tokenizer libraries on whole texts."""

import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from voxarbor.llm import bpe, tokens

WORD = public_tokenizers.path("word_bpe_49k.json")
RANKS = bpe.ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
CODER = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
SIGNS = ["a", "the", "Straße", "é", "é", "́", "'s", "'", "12", "3", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", " ", "-",
         "!!", "<|endoftext|>", "<|", "|>", "日本", "😀", "ß", "İ", "don't", "_", "\x00", "&&&", "\r\n"]


def strange(n, seed):
    rnd = random.Random(seed)
    return "".join(rnd.choice(SIGNS) for _ in range(n))


TEXTS = {i: strange(10 + 37 * i, i) for i in range(40)}


def test_counts_equal_the_library(docs):
    tokenizer = Tokenizer.from_file(WORD)
    want = {i: len(tokenizer.encode(t, add_special_tokens=False)) for i, t in TEXTS.items()}
    for chunk, overlap in ((32768, 512), (200, 16), (64, 4)):
        got = tokens.token_counts(docs(TEXTS), WORD, chunk=chunk, overlap=overlap).collect()
        assert {r.doc_id: r.n_tokens for r in got} == want
    assert all(r.n_bytes == len(TEXTS[r.doc_id].encode()) for r in got)


@pytest.mark.parametrize("text", ["ab" * 5000, "word " * 3000, "a" * 3000 + " " + "b" * 3000, "1" * 2000, "日本語" * 900])
def test_splices_and_widened_overlaps(text):
    tokenizer = Tokenizer.from_file(WORD)

    def starts(part):
        return [a for a, _ in tokenizer.encode(part, add_special_tokens=False).offsets]

    assert tokens.spliced_count(starts, text, 500, 20) == len(starts(text))


def test_limit_and_odd_rows(odd, none):
    got = sorted(tokens.token_counts(odd, WORD, limit=100).collect(), key=str)
    assert len(got) == 10
    by = {r.doc_id: r for r in got}
    assert (by[1].n_bytes, by[1].n_tokens, by[1].over_limit) == (0, 0, False)
    assert by[2].n_tokens == by[3].n_tokens == 0 and by[4].n_tokens == 2 and by[8].n_tokens == 30_000 and by[8].over_limit
    assert by[5].n_tokens == len(Tokenizer.from_file(WORD).encode("x" * 200_000, add_special_tokens=False))
    assert tokens.token_counts(none, WORD).count() == 0


def test_bpe_round_trip(docs):
    coded = bpe.encode(docs(TEXTS), RANKS, public_tokenizers.PATTERN, chars=2000)
    for r in bpe.decode(coded, RANKS).collect():
        ids = CODER.encode_ordinary(TEXTS[r.doc_id])
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_tokens == len(ids)
        assert bytes(r.decoded) == TEXTS[r.doc_id].encode()


def test_bpe_odd_rows(odd, none):
    got = bpe.decode(bpe.encode(odd, RANKS, public_tokenizers.PATTERN), RANKS).collect()
    want = sorted((r.doc_id or 0, (r.text or "").encode()) for r in odd.collect())
    assert sorted((r.doc_id or 0, bytes(r.decoded)) for r in got) == want
    assert bpe.encode(none, RANKS, public_tokenizers.PATTERN).count() == 0


def test_long_text_is_taken_in_pieces(docs, monkeypatch):
    monkeypatch.setattr(bpe, "LONG", 50)
    got = bpe.encode(docs(TEXTS), RANKS, public_tokenizers.PATTERN).collect()
    assert all(np.frombuffer(r.ids, "<u4").tolist() == CODER.encode_ordinary(TEXTS[r.doc_id]) for r in got)


def test_packed_arrays():
    arrays = [np.array([], np.uint32), np.array([1, 70000], np.uint32), np.array([-5, 9], np.int64)]
    assert [a.tolist() for a in bpe.unpack(bpe.pack(*arrays))] == [a.tolist() for a in arrays]
