"""Token files and WARC archives."""

import base64
import hashlib
import os
import random
import zlib

import numpy as np
import public_tokenizers as T
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from amberline.llm import token_files, warc
from amberline.llm.common import filesystem, publish
from amberline.tables import shared_dir

PATH = T.path("word_bpe_49k.json")


def want_tokens(docs):
    t = Tokenizer.from_file(PATH)
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out, start = [], 0
    for doc_id, text in rows:
        ids = [*t.encode(text, add_special_tokens=False).ids, 2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    return out


def test_publish_again(tmp_path):
    """A task that is tried again leaves its second file, whole, and nothing else."""
    for data in (b"first, longer", b"second"):
        publish(f"file://{tmp_path}/a/x.bin", lambda out, data=data: out.write(data))
    with pytest.raises(RuntimeError):

        def broken(out):
            out.write(b"half")
            raise RuntimeError

        publish(f"file://{tmp_path}/a/x.bin", broken)
    assert (tmp_path / "a" / "x.bin").read_bytes() == b"second"


def test_round_trip(documents, odd):
    for docs in (documents, odd, documents.where("false")):
        got = token_files.write_and_read(docs, PATH, 2).collect()
        assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == want_tokens(docs)


def test_texts_with_added_tokens(spark):
    """As the untouched tokenizer has it: the tokenizer's added tokens are found in the raw text, in their own case."""
    texts = ["Hello <|endoftext|> world<|endoftext|>x", "a <|ENDOFTEXT|>b <|endof text|>", "É<|startoftext|>É x", "<|endoftext|>", "\x1c<|ENDOFTEXT|>\x1d", "<|endoftext|> " * 200 + "ß", "it's we'll 'S rock'n'roll 3rd e\u0301 H\u0331x ,.;'", "\u00a0a\u2003b\u3000", "\u0301 \u0331x", "İI ſ ǅ ⅷ ½"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = token_files.write_and_read(docs, PATH, 2).collect()
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == want_tokens(docs)


def test_words_against_the_tokenizer(monkeypatch):
    """Random texts of odd characters, with a memory of few words."""
    monkeypatch.setattr(token_files, "MEMO_WORDS", 50)
    rng, plain, own = random.Random(5), Tokenizer.from_file(PATH), token_files.WordTokenizer(PATH)
    alphabet = "abcdeABC'’st0١9.,!? \t\n\x1f\u00a0éÉßİǅ日本\u0301\u0331\u200d😀<|>"
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(3000)] + [None]
    for at in range(0, len(texts), 97):
        part = texts[at : at + 97]
        want = [np.array(plain.encode(t or "", add_special_tokens=False).ids, own.dtype).tobytes() for t in part]
        assert own.encode(pa.array(part, pa.string())) == want


def test_one_id_of_many_documents(spark):
    rows = [(7 if i % 3 else i, f"text {i % 50} of {i}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = token_files.write_and_read(docs, PATH, 2).collect()
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == want_tokens(docs)


def test_small_files_and_single_documents(spark, documents, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_BYTES", 10_000)
    folder = shared_dir(spark, "tokens")
    token_files.write(documents, folder, PATH, 2)
    files, path = filesystem(folder)
    names = [n for n in os.listdir(path) if n.endswith(".tokens")]
    assert len(names) > 8 and len([n for n in os.listdir(path) if n.endswith(".dictionary")]) == 1
    want = {r[0]: r[4] for r in want_tokens(documents)}
    found = {}
    for name in names:
        f = token_files.TokenFile(f"{folder}/{name}")
        for doc_id in (0, 77, 199):
            ids = f.document(doc_id)
            if ids is not None:
                found[doc_id] = ids.tolist()
    assert found == {d: want[d] for d in (0, 77, 199)}
    no_ids = token_files.read(spark, folder, with_ids=False)
    assert no_ids.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and no_ids.count() == 200


def test_warc(spark):
    rows = [(3, "http://www.b.org/x", "same"), (1, "http://a.b.org:80/y?Q=1", "same"), (2, "http://b.org/x", "one"), (4, None, None), (5, "no url", ""), (6, "http://é.org/", "Łódź\r\n\r\nx"), (None, "http://c.org/", "same"), (7, "http://c.org/a\r\nb", "x" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"first": F.lit(0), "same": F.lit(1), "file": F.lit("f")})
    folder = shared_dir(spark, "warc")
    warc.index(warc.write(pages, folder), folder)
    got = {r.page_id: tuple(r)[1:] for r in warc.read(spark, folder).collect()}
    code = lambda s: base64.b32encode(hashlib.sha1(s.encode()).digest()).decode()
    first = {}
    for i, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(html or "", i)
    for i, _, html in rows:
        html = html or ""
        revisit = first[html] != i
        assert got[i] == (len(html.encode()), code(html), "revisit" if revisit else "response", first[html] if revisit else None)
    look = warc.Lookup(spark, folder)
    captures = look.captures("https://B.org/x")
    assert sorted(c[1] for c in captures) == [2, 3]
    assert {look.read(c)[0]["WARC-Type"] for c in captures} == {"response", "revisit"}
    assert look.read(look.captures("http://é.org/")[0])[1].decode() == "Łódź\r\n\r\nx"
    assert look.captures("http://nothing.org/") == []
    assert warc.write_and_read(pages.where("false")).count() == 0


def test_warc_record_names():
    """Pages without an id, and pages that repeat one, bear different names; a revisit names its response."""
    head = lambda *x: warc.parse(warc.record(*x))[0]
    names = [head(i, "http://a.org/", text, None, False)["WARC-Record-ID"] for i, text in ((None, b"x"), (None, b"y"), (5, b"x"), (5, b"y"))]
    assert len(set(names)) == 4
    again = head(9, "http://b.org/", b"x", 5, True)
    assert again["WARC-Refers-To"] == names[2] and again["WARC-Record-ID"] not in names


def test_warc_index_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_CAPTURES", 7)
    monkeypatch.setattr(warc, "INDEX_CAPTURES", 30)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 5_000)
    rows = [(i, f"http://h{i % 9}.org/{i % 50}", f"text {i % 180}") for i in range(400)]
    folder = shared_dir(spark, "warc")
    warc.index(warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), folder), folder)
    look = warc.Lookup(spark, folder)
    for url in ("http://h3.org/3", "http://h0.org/45", "http://h8.org/8"):
        assert sorted(c[1] for c in look.captures(url)) == [i for i, u, _ in rows if u == url]
    assert warc.read(spark, folder).count() == 400


def test_warc_lookup_of_a_table(spark, monkeypatch):
    """A key of many captures, keys that are not there, keys that repeat, over blocks that share a key."""
    monkeypatch.setattr(warc, "BLOCK_CAPTURES", 7)
    monkeypatch.setattr(warc, "INDEX_CAPTURES", 30)
    rows = [(i, None if i % 3 == 0 else f"http://h{i % 9}.org/{i % 50}", f"text {i}") for i in range(300)]
    folder = shared_dir(spark, "warc")
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.index(warc.write(pages, folder), folder)
    asked = [None, "http://h4.org/4", "http://h4.org/4", "http://h1.org/0", "http://nothing.org/", "http://zzz.org/"]
    got = warc.lookup(warc.keys_of(spark.createDataFrame([(u,) for u in asked], "url string")), folder).collect()
    assert sorted(r.page_id for r in got) == sorted(i for i, u, _ in rows if u in set(asked))
    assert warc.records(warc.lookup(warc.keys_of(pages), folder), folder).count() == 300


def test_url_keys():
    assert warc.url_key("http://www.a.example.org:80/x?q#f") == "org,example,a)/x?q"
    assert warc.url_key("https://A.org:8443") == "org,a:8443)/"
    assert warc.url_key("http://[bad") == "http://[bad" and warc.url_key(None) == ""
