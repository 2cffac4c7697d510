import hashlib

import public_tokenizers as T
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from amberline.llm import prefix_bpe as B

PATH = T.path("byte_bpe_multi_50k.tiktoken")
OWN = B.encoder(PATH, T.PATTERN)
THEIRS = tiktoken.Encoding("own", pat_str=T.PATTERN, mergeable_ranks=OWN.vocabulary.ranks, special_tokens={})
TEXT = st.text(alphabet="aabcdeethton  \n'slvrz1日本é\U0001f600", max_size=60)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_encodes_as_the_library(text):
    ids = OWN.encode(text)
    assert ids == THEIRS.encode_ordinary(text)
    assert OWN.decode(ids) == text.encode()


@settings(max_examples=200, deadline=None)
@given(TEXT, st.integers(0, 99), st.integers(0, 99), TEXT)
def test_every_prefix_and_any_edit(text, i, j, new):
    data, new = text.encode(), new.encode()
    p = B.Prefixes(OWN.vocabulary, data)
    for end in range(len(data) + 1):
        assert p.tokens(end) == (OWN.vocabulary.merged(data[:end]) if end else [])
    i, j = sorted((i % (len(data) + 1), j % (len(data) + 1)))
    p.edit(i, j, new)
    edited = data[:i] + new + data[j:]
    assert p.tokens() == (OWN.vocabulary.merged(edited) if edited else [])


def test_an_edit_stops_early():
    p = B.Prefixes(OWN.vocabulary, b"ab cd ef gh " * 2000)
    assert p.edit(100, 103, b"xyz!") < 2000


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, max_size=8))
def test_growing_text(parts):
    g, whole = B.GrowingText(OWN), ""
    for part in parts:
        g.append(part)
        whole += part
        assert g.tokens() == THEIRS.encode_ordinary(whole)


def test_digests(documents, odd):
    for docs in (documents, odd, documents.where("false")):
        got = sorted(map(tuple, B.digests(docs, PATH, T.PATTERN).collect()), key=str)
        want = []
        for r in docs.collect():
            ids = THEIRS.encode_ordinary(r.text or "")
            want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
        assert got == sorted(want, key=str)


def test_ids_and_back(odd):
    encoded = B.encode_texts(odd, PATH, T.PATTERN)
    assert sorted(bytes(r.decoded).decode() for r in B.decode_ids(encoded, PATH, T.PATTERN).collect()) == sorted(r.text or "" for r in odd.collect())


def test_a_missing_byte_is_an_error():
    with pytest.raises(ValueError):
        B.Prefixes(B.Vocabulary({b"a": 0}), b"b")
