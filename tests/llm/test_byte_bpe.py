from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from evenfold.llm import byte_bpe
from evenfold.llm.queries import rank_file
from evenfold.llm.spans import pieces, utf8
from tests.llm.odd import empty, odd, odd_rows


@pytest.fixture(scope="module")
def words():
    return byte_bpe.Vocabulary(byte_bpe.read_ranks(rank_file()))


@pytest.fixture(scope="module")
def library(words):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=words.rank, special_tokens={})


def test_perfect_hash_is_minimal(words):
    assert sorted(words.hash.slot_of.tolist()) == list(range(len(words.tokens)))


def test_ids_equal_the_library(words, library):
    rng = random.Random(1)
    letters = "ab's tlrevmd \n\t1²é漢.!'   \x00\x1c\x85 🎉"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(50))) for _ in range(3000)]
    texts += ["", "it's x'll 's don't  's\n\n a''s 'sab 're've'red I'M", "a" * 3000, *[r[1] or "" for r in odd_rows()]]
    coder, found = byte_bpe.Encoder(words, remembered=64), []
    buf, offs = utf8(pa.array(texts))
    for a, b in pieces(offs, 5000):
        ids, at = coder.encode(buf[offs[a]:offs[b]], offs[a:b + 1] - offs[a])
        found += [ids[x:y].tolist() for x, y in zip(at[:-1], at[1:])]
    assert found == [library.encode_ordinary(t) for t in texts]
    assert [byte_bpe.decode(i, words.tokens) for i in found] == [t.encode() for t in texts]


def test_odd_rows(spark, library):
    shared = byte_bpe.vocabulary(spark, rank_file())
    encoded = byte_bpe.encode(odd(spark), shared)
    got = sorted(((r["doc_id"], r["text"], list(r["ids"])) for r in encoded.collect()), key=repr)
    assert got == sorted(((r[0], r[1], library.encode_ordinary(r[1] or "")) for r in odd_rows()), key=repr)
    assert byte_bpe.digests(encoded, shared).count() == len(odd_rows())
    assert byte_bpe.digests(byte_bpe.encode(empty(spark), shared), shared).count() == 0


def test_words_with_one_hash_get_their_own_ids():
    """1,024 letters in the pattern of bit parity and with both letters swapped meet in any polynomial hash modulo a power of two."""
    first = "".join("ab"[k.bit_count() % 2] for k in range(1024))
    other = first.translate(str.maketrans("ab", "ba"))
    ranks = byte_bpe.read_ranks(rank_file())
    coder = byte_bpe.Encoder(byte_bpe.Vocabulary(ranks))
    raw = [w.encode() for w in (first, other, first, f"{other} {first}")]
    buf, offs = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    ids, at = coder.encode(buf, offs)
    tokens = coder.v.tokens
    assert [b"".join(tokens[i] for i in ids[a:b].tolist()) for a, b in zip(at, at[1:])] == raw
    assert ids[at[0]:at[1]].tolist() == ids[at[2]:at[3]].tolist() != ids[at[1]:at[2]].tolist()
