"""Decontamination, language, licences and LM scores."""

import glob
import hashlib
import math
import os
import re
import sysconfig
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
import xxhash
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from amberline.llm import decontaminate, elias_fano, language_id, license_scan, ngram_lm

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def want_report(docs, items):
    windows = defaultdict(set)
    for b in items:
        w = WORD.findall((b.text or "").translate(LOWER))
        n = min(13, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[s : s + n])].add(b.item_id)
    sizes = {len(k) for k in windows}
    out = []
    for d in docs:
        w = WORD.findall((d.text or "").translate(LOWER))
        hit, found = set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    found |= windows[tuple(w[s : s + n])]
                    hit |= set(range(s, s + n))
        ids = sorted(str(i) for i in found if i is not None)
        out.append((d.doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def got_report(docs, items):
    return sorted((tuple(r) for r in decontaminate.report(docs, items).collect()), key=str)


def test_report(documents, benchmark_items):
    assert got_report(documents, benchmark_items) == want_report(documents.collect(), benchmark_items.collect())


def test_report_of_odd_cases(spark, odd):
    long = " ".join(f"w{i % 37}" for i in range(400))
    items = spark.createDataFrame([(1, "a b C d"), (1, "a b C d"), (2, long), (3, None), (4, "!!"), (5, "word " * 20), (6, "naïve"), (None, "x"), (7, "other TEXT of, the")], "item_id long, text string")
    more = spark.createDataFrame([(20, f"pre {long} post"), (21, " ".join(f"w{i % 37}" for i in range(5, 18))), (22, " ".join(f"w{i % 37}" for i in range(5, 17))), (23, "A b c d e " * 50)], "doc_id long, text string")
    docs = odd.select("doc_id", "text").unionByName(more)
    assert got_report(docs, items) == want_report(docs.collect(), items.collect())
    assert got_report(odd, items.where("false")) == want_report(odd.collect(), [])
    assert got_report(odd.where("false"), items) == []
    kept = decontaminate.clean(odd, items)
    bad = {(r[0], r[1]) for r in want_report(odd.collect(), items.collect()) if r[5]}
    assert kept.columns == odd.columns and kept.count() == sum((r[0], r[1]) not in bad for r in want_report(odd.collect(), items.collect()))


def test_positions_beyond_the_bits(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "POSITION_BITS", 5)
    passage = " ".join(f"p{i}" for i in range(15))
    docs = spark.createDataFrame([(1, " ".join(f"a{i}" for i in range(100)) + f" {passage} " + " ".join(f"b{i}" for i in range(50)))], "doc_id long, text string")
    items = spark.createDataFrame([(1, f"x {passage} y")], "item_id long, text string")
    assert got_report(docs, items) == want_report(docs.collect(), items.collect())


def test_time_grows_with_the_text(spark):
    """A document that is hit throughout: twice the words take about twice the time, not four times."""
    items = spark.createDataFrame([(1, "word " * 20)], "item_id long, text string")
    took = []
    for n in (20_000, 20_000, 40_000):
        docs = spark.createDataFrame([(1, "word " * n)], "doc_id long, text string")
        start = time.monotonic()
        assert [(r.n_words, r.n_hit) for r in decontaminate.report(docs, items).collect()] == [(n, n)]
        took.append(time.monotonic() - start)
    assert took[2] < 3 * took[1]


def test_clean_under_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b c d", 5), (2, None, 6), (3, "other", 7)], "_bad_id long, _bad_text string, text_hash long")
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    left = decontaminate.clean(docs, items, "_bad_id", "_bad_text")
    assert left.columns == docs.columns and sorted(map(tuple, left.collect())) == [(2, None, 6), (3, "other", 7)]


def test_languages(spark, documents, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language_id.evaluated(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert out.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    got = {(r.doc_id, r.lang_pred): r for r in language_id.evaluated(odd).collect()}
    assert got[(3, "und")].rejected and got[(4, "und")].score == 0 and (8, "und") in got
    assert all(0 <= r.score <= 1 and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got.values())
    assert {r.lang_pred for r in language_id.predict(documents, {}).collect()} == {"und"}
    assert language_id.evaluated(documents.where("false")).count() == 0
    kept = language_id.accepted(odd, language_id.fit(odd))
    assert kept.columns == odd.columns and kept.where("text IS NULL OR text IN ('', '!?')").count() == 0
    assert not language_id.fit(documents.withColumn("lang", F.lit(None).cast("string")))


def test_narrow_margins(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    learned = language_id.learned(docs)
    same = language_id.Classifier({"a": learned["en"], "b": learned["en"], "c": learned["fr"]})
    text = "The weather was fine in the morning and the children went to the river with their mother. " * 3
    label, score, rejected = same.predict(text)
    assert label == "a" and score > 0.4 and rejected  # two equal sizes
    assert not language_id.Classifier(learned).predict(text)[2] and not language_id.Classifier({"en": learned["en"]}).predict(text)[2]
    out = language_id.evaluated(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang = lang_pred")
    assert out.select(F.avg(F.col("rejected").cast("int"))).first()[0] < 0.03


def test_languages_by_a_plain_version(documents):
    """The whole small table: dictionaries, sizes, scores and margins computed anew, row by row."""
    rows = documents.collect()
    letters = lambda t: f" {re.sub(r'[^a-zA-ZÀ-ɏ]+', ' ', t.lower()).strip()} ".encode()
    assert all(re.fullmatch(r"[\x00-ɏ‐-⁯€😀-🙿]*", r.text or "") for r in rows)
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    place = lambda i: np.uint64(xxhash.xxh64_intdigest(i.to_bytes(8, "little", signed=True), 42)).astype(np.int64)
    pieces = defaultdict(list)
    for r in rows:
        if r.lang and not held(r.doc_id) and any(map(str.isalpha, r.text or "")):
            data = letters(r.text)
            step = max(1, len(data) // language_id.SAMPLE_PIECES)
            pieces[r.lang].append((place(r.doc_id), r.doc_id, b"".join(data[i : i + language_id.PIECE_BYTES] for i in range(0, len(data), step))[: language_id.SAMPLE_PIECES * language_id.PIECE_BYTES]))
    assert all(len(x) <= language_id.SAMPLE_DOCS for x in pieces.values())
    compress = {}
    for lang, x in sorted(pieces.items()):
        d = zstandard.ZstdCompressionDict(b"".join(p for *_, p in sorted(x)), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        compress[lang] = zstandard.ZstdCompressor(level=language_id.LEVEL, dict_data=d, write_content_size=False, write_dict_id=False).compress
    got = {r.doc_id: r for r in language_id.evaluated(documents).collect()}
    for r in rows:
        if not any(map(str.isalpha, r.text or "")):
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        data, sizes = letters(r.text), {}
        for lang, c in compress.items():
            parts = [data[i : i + language_id.CHUNK_BYTES] for i in range(0, len(data), language_id.CHUNK_BYTES)]
            sizes[lang] = sum(len(c(p if len(p) >= language_id.SHORT_BYTES else p * 3)) for p in parts)
        best = min(sizes, key=lambda lang: (sizes[lang], lang))
        score = 1 / sum(math.exp(-language_id.NATS_A_BYTE * (s - sizes[best])) for s in sizes.values())
        margin = sorted(sizes.values())[1] - sizes[best]
        assert (got[r.doc_id].lang_pred, got[r.doc_id].held_out) == (best, held(r.doc_id)) and abs(got[r.doc_id].score - score) < 1e-9
        assert got[r.doc_id].rejected == (margin <= language_id.LEAST_MARGIN * len(data))


def test_too_many_languages(spark):
    docs = spark.range(70).select(F.col("id").alias("doc_id"), F.lit("text").alias("text"), F.concat(F.lit("l"), "id").alias("lang"))
    with pytest.raises(ValueError):
        language_id.fit(docs)


def test_licences(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"
    rows = [("p/LICENSE", mit), ("p/a/x.py", "code here"), ("p/a/b/COPYING", "Licensed under the Apache License, Version 2.0"), ("p/a/b/c/y.py", "code"), ("p/a/z.py", "# licensed under CC BY-NC 4.0.\nmore"), ("q/x", "plain"), (None, "Released under the MIT License."), (None, None), ("p/a/z.py", ""), ("top", None)]
    files = spark.createDataFrame(rows, "path string, text string").withColumns({"licence": F.lit("?"), "score": F.lit(0), "digest": F.lit(1)})
    got = sorted(((r.path, r.licence, r.basis, r.origin) for r in license_scan.scan(files).collect()), key=str)
    want = [("p/LICENSE", "MIT", "file", "p/LICENSE"), ("p/a/x.py", "MIT", "inherited", "p/LICENSE"), ("p/a/b/COPYING", "Apache-2.0", "file", "p/a/b/COPYING"), ("p/a/b/c/y.py", "Apache-2.0", "inherited", "p/a/b/COPYING"), ("q/x", None, "none", None), ("top", None, "none", None)]
    want += [("p/a/z.py", "CC-BY-NC-4.0", "notice", "p/a/z.py")] * 2 + [(None, "MIT", "notice", None)] * 2
    assert got == sorted(want, key=str)
    assert license_scan.scan(files.where("false")).count() == 0


def test_whole_licences_and_headers(spark):
    header = "/*\n * This program is free software: you can\n * redistribute it and/or modify it under the terms of the\n * GNU General Public License as published by the Free\n * Software Foundation, either version 3 of the\n * License, or (at your option) any later version.\n *\n */\nint main;"
    rows = [(f"{name}/LICENSE", f"Copyright 2020 Some Holder\n\n{text}") for name, text in license_scan.TEXTS.items()] + [(f"{name}/src/x.py", "code") for name in license_scan.TEXTS]
    rows += [("h/a.c", header), ("h/b.c", "// SPDX-License-Identifier: MPL-2.0\ncode"), ("h/c.c", "// SPDX-License-Identifier: GPL-2.0-or-later"), ("h/d.c", "// SPDX-License-Identifier: MIT AND ISC and others"), ("h/e.txt", "The license of the work is the right of the owner of the work.")]
    rows += [(f"other/{i}", "nothing to see here") for i in range(300)]
    got = {r.path: (r.licence, r.basis) for r in license_scan.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    for name in license_scan.TEXTS:
        assert got[f"{name}/LICENSE"] == (name, "file") and got[f"{name}/src/x.py"] == (name, "inherited")
    assert got["h/a.c"] == ("GPL-3.0", "notice") and got["h/b.c"] == ("MPL-2.0", "notice") and got["h/c.c"] == ("GPL-2.0", "notice")
    assert got["h/d.c"] == got["h/e.txt"] == (None, "none")


def test_licence_scores(spark):
    """The cosine by its definition, over a handful of files."""
    texts = ["Licensed under the Apache License, Version 2.0.", "licensed licensed of nothing known", "no notice", "This work is licensed under the GNU General Public License, version 3."]
    files = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, text string")
    words = lambda t: [w for w in re.split(r"[\W_]+", t.lower()) if w]
    n = len(texts)
    idf = lambda w, known: math.log((1 + n) / (1 + (sum(w in words(t) for t in texts) if known else 0))) + 1
    vocabulary = {w for _, t in license_scan.TEMPLATES for w in words(t)}
    vector = lambda t: {w: k * idf(w, w in vocabulary) for w, k in Counter(words(t)).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    got = {r.path: (r.licence, r.score) for r in license_scan.scan(files, least=0.05).collect()}
    for i in (0, 1, 3):
        v = vector(texts[i])
        best = min((-round(sum(v.get(w, 0) * x for w, x in vector(t).items()) / norm(v) / norm(vector(t)), 9), name) for name, t in license_scan.TEMPLATES)
        assert got[str(i)][0] == best[1] and abs(got[str(i)][1] + best[0]) < 1e-8
    assert got["2"] == (None, None)


def want_licences(files, least=license_scan.LEAST_COSINE):
    """(licence, score, basis, origin, margin) of each of (path, text), all words counted, as defined."""
    words = lambda t: [w for w in regex.split(r"[^\p{L}\p{N}]+", t.lower()) if w]
    templates = [(name, Counter(words(t)), False) for name, t in license_scan.TEMPLATES] + [(name, Counter(words(t)), True) for name, t in license_scan.TEXTS.items()]
    notice, whole_file, pieces = re.compile(license_scan.NOTICE), re.compile(license_scan.LICENCE_FILE), {}
    for path, text in files:
        text = text or ""
        own = [(False, x) for x in [*text.split("\n"), *regex.split(license_scan.GAP, text)] if notice.search(x)] if notice.search(text) else []
        own += [(True, text)] if path and whole_file.search(path) else []
        pieces.setdefault((path, text), []).extend(dict.fromkeys(x for x in own if x[1]))
    different = {x for own in pieces.values() for x in own}
    vectors = {x: Counter(words(x[1])) for x in different}
    n, df = sum(bool(v) for v in vectors.values()), Counter(w for v in vectors.values() for w in v)
    idf = lambda w: math.log((1 + n) / (1 + df[w])) + 1
    weighed = lambda v: {w: k * idf(w) for w, k in v.items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    templates = [(name, v, norm(v), full) for name, v, full in [(name, weighed(v), full) for name, v, full in templates]]
    best = {}
    for x, v in vectors.items():
        v, top = weighed(v), {}
        for name, t, size, full in templates:
            dot = sum(y * t.get(w, 0) for w, y in v.items())
            if dot and (x[0] or not full):
                top[name] = max(top.get(name, 0), round(dot / norm(v) / size, 9))
        ranked = sorted((-s, name) for name, s in top.items())
        if ranked and -ranked[0][0] >= least:
            best[x] = (not x[0], ranked[0][0], ranked[0][1], (ranked[1][0] if len(ranked) > 1 else 0) - ranked[0][0])
    own, directories, out = {}, {}, {}
    for (path, _), found in pieces.items():
        for x in found:
            if x in best:
                own[path] = min(own.get(path, best[x]), best[x])
    for path, x in own.items():
        if path and whole_file.search(path):
            at = path.rpartition("/")[0]
            directories[at] = min(directories.get(at, (x[1], x[2], path, x[3])), (x[1], x[2], path, x[3]))
    for path, _ in files:
        if path in own:
            _, score, name, margin = own[path]
            out[path] = (name, -score, "file" if path and whole_file.search(path) else "notice", path, margin)
            continue
        at = path.rpartition("/")[0] if path else None
        while at and at not in directories:
            at = at.rpartition("/")[0]
        up = directories.get(at or "") if path else None
        out[path] = (up[1], -up[0], "inherited", up[2], up[3]) if up else (None, None, "none", None, None)
    return out


def same_licences(got, want):
    assert {r.path: (r.licence, r.basis, r.origin) for r in got} == {p: (w[0], w[2], w[3]) for p, w in want.items()}
    for r in got:
        w = want[r.path]
        assert (r.score is None) == (w[1] is None) and (r.score is None or (abs(r.score - w[1]) < 1e-8 and abs(r.margin - w[4]) < 1e-8))


def test_licences_of_a_whole_table(documents):
    from amberline.llm import queries

    files = queries.licence_files(documents).collect()
    # A tenth of the files is its directory's NOTICE; a few more notices there let others inherit.
    noted = [(r.path, r.text) for r in files]
    noted += [(f"{p.rsplit('/', 1)[0]}/LICENSE", t) for (p, _), (_, t) in zip(noted[::25], license_scan.TEMPLATES)]
    want = want_licences(noted)
    assert {w[2] for w in want.values()} == {"file", "notice", "inherited", "none"}
    df = documents.sparkSession.createDataFrame(noted, "path string, text string")
    same_licences(license_scan.scan(df, all_words=True).collect(), want)
    plain = want_licences([(r.path, r.text) for r in files])
    number = lambda p: int(re.search(r"(\d+)(\.txt)?$", p)[1])
    got = {r.doc_id: (r.licence, r.basis, r.origin) for r in queries.op9_license_scan(documents.sparkSession, "/root/testdata/sf0.001").collect()}
    assert got == {number(p): (w[0], w[2], w[3] and number(w[3])) for p, w in plain.items()}


def test_odd_licence_files(spark):
    mit = license_scan.TEXTS["MIT"]
    rows = [("a/LICENSE", None), ("b/LICENSE", ""), ("c/LICENSE", mit), ("c/LICENSE", mit), ("c/x", "code"), ("d/COPYING", mit + " word" * 30_000), ("e/LICENSE", "!?"), ("f/NOTICE", "Some product\n\nLicensed under the Apache License, Version 2.0\n"), ("f/y", None)]
    got = license_scan.scan(spark.createDataFrame(rows, "path string, text string"), all_words=True)
    assert got.count() == len(rows)
    same_licences(got.collect(), want_licences(rows))
    assert {r.path: r.licence for r in got.collect()} | {"c/x": "MIT", "f/y": "Apache-2.0", "d/COPYING": None} == {r.path: r.licence for r in got.collect()}
    assert license_scan.scan(got.where("false").select("path", F.lit("").alias("text")), all_words=True).count() == 0


def test_licence_files_of_this_machine(spark, documents):
    """Licence files that hold just one known licence, by its own words, among other files: nine in ten are told."""
    phrases = {"MIT": "permission is hereby granted, free of charge", "Apache-2.0": "version 2.0, january 2004", "BSD": "redistribution and use in source and binary forms", "ISC": "permission to use, copy, modify, and", "GPL-3.0": "gnu general public license version 3, 29 june", "GPL-2.0": "gnu general public license version 2, june", "LGPL-2.1": "gnu lesser general public license version 2.1,", "MPL-2.0": "mozilla public license version 2.0"}
    paths = glob.glob("/usr/share/common-licenses/*") + glob.glob(f"{sysconfig.get_paths()['purelib']}/**/LICENSE*", recursive=True)
    known = {}
    for i, path in enumerate(p for p in sorted(paths) if os.path.isfile(p)):
        with open(path, errors="replace") as f:
            text = f.read()
        flat = " ".join(text.lower().split())
        names = [n for n, phrase in phrases.items() if flat.count(phrase) == 1]
        if len(names) == 1:
            name = ("BSD-3-Clause" if "endorse or promote" in flat else "BSD-2-Clause") if names == ["BSD"] else names[0]
            known[f"m/{i}/LICENSE"] = (name, text)
    if len(known) < 20:
        pytest.skip("too few licence files here")
    files = spark.createDataFrame([(p, t) for p, (_, t) in known.items()], "path string, text string").unionByName(documents.select(F.concat(F.lit("d/"), "doc_id").alias("path"), "text"))
    got = {r.path: r.licence for r in license_scan.scan(files, all_words=True).collect()}
    assert sum(got[p] == name for p, (name, _) in known.items()) >= 0.9 * len(known)


def want_scores(docs):
    tokens = [(r.doc_id, re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (r.text or "").encode())) + [None]) for r in docs]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2 if i is not None else False
    single, pairs = Counter(), Counter()
    teach = [t for i, t in tokens if i is not None and not held(i)]
    for t in teach:
        single.update(t)
        pairs.update(zip(["start", *t[:-1]], t))
    n, v = sum(single.values()), len(single)
    context = dict(single) | {"start": len(teach)}
    mass = defaultdict(float)
    for (u, w), k in pairs.items():
        mass[u] += (k - 0.75) / context[u] if k >= 2 else 0
    out = []
    for i, t in tokens:
        base = sum(math.log10((single[w] + 1) / (n + v + 1)) for w in t)
        score = 0.0
        for u, w in zip(["start", *t[:-1]], t):
            p = (single[w] + 1) / (n + v + 1)
            if u in context and w in single:
                k = pairs[u, w]
                p = ((k - 0.75) / context[u] if k >= 2 else 0) + (1 - mass[u]) * p
            score += math.log10(p)
        out.append((i, held(i), len(t), sum(w in single for w in t), n, base, score))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [2_000_000, 3_000])
def test_scores(documents, odd, monkeypatch, block):
    monkeypatch.setattr(ngram_lm, "BLOCK_TOKENS", block)
    for docs in (documents, odd, documents.where("false"), odd.where("doc_id IS NULL")):
        got = sorted((tuple(r) for r in ngram_lm.score(docs).collect()), key=str)
        want = want_scores(docs.collect())
        assert [r[:5] for r in got] == [r[:5] for r in want]
        for g, w in zip(got, want, strict=True):
            assert abs(g[5] - w[5]) <= 1e-9 * abs(w[5]) + 1e-9 and abs(g[6] - w[6]) <= 0.002 * w[2]


def test_every_pair_is_kept(documents):
    """The query's scores, by a plain model that keeps pairs seen once too."""
    from amberline.llm import queries

    got = sorted((tuple(r) for r in queries.op10_ngram_lm(documents.sparkSession, "/root/testdata/sf0.001").collect()), key=str)
    tokens = {r.doc_id: re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (r.text or "").encode())) + [None] for r in documents.collect()}
    steps = {i: list(zip(["start", *t[:-1]], t)) for i, t in tokens.items()}
    teach = [i for i in tokens if zlib.crc32(str(i).encode()) % 7 != 2]
    single, pairs = Counter(w for i in teach for w in tokens[i]), Counter(x for i in teach for x in steps[i])
    n, context, successors = sum(single.values()), {**single, "start": len(teach)}, Counter(u for u, _ in pairs)
    plain = lambda w: (single[w] + 1) / (n + len(single) + 1)
    # All of a context's occurrences have a successor, so discounting leaves 0.75 for each different one.
    paired = lambda u, w: (max(pairs[u, w] - 0.75, 0) + 0.75 * successors[u] * plain(w)) / context[u]
    for g in got:
        want = sum(math.log10(paired(u, w) if u in context and w in single else plain(w)) for u, w in steps[g[0]])
        assert abs(g[6] - want) <= 0.002 * g[2]


def test_a_word_never_seen_after_a_frequent_pair(spark):
    """A context with one successor, so often that its quantised probability is 1."""
    rows = [(i, "of the " * 40 + "end") for i in range(60)]
    held = [i for i in range(60, 90) if zlib.crc32(str(i).encode()) % 7 == 2]
    docs = spark.createDataFrame(rows + [(i, "of end of end the the") for i in held], "doc_id long, text string")
    for least in (1, 2):
        got = {r.doc_id: r for r in ngram_lm.score(docs, min_count=least).collect()}
        assert all(math.isfinite(r.score) for r in got.values())
    for w in want_scores(docs.collect()):
        assert abs(got[w[0]].score - w[6]) <= 0.002 * w[2]


def test_scores_over_many_shards(documents, monkeypatch):
    monkeypatch.setattr(ngram_lm, "SHARD_TOKENS", 1_000)
    got = sorted((tuple(r) for r in ngram_lm.score(documents).collect()), key=str)
    for g, w in zip(got, want_scores(documents.collect()), strict=True):
        assert g[:5] == w[:5] and abs(g[6] - w[6]) <= 0.002 * w[2]


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(0, 1 << 40), max_size=200), st.integers(0, 1 << 41))
def test_elias_fano(values, other):
    values = np.array(sorted(values), np.uint64)
    e = elias_fano.EliasFano.of(values)
    if len(values):
        assert (e.access(np.arange(len(values))) == values).all()
    asked = np.concatenate([values, np.array([other], np.uint64)])
    at = {int(x): i for i, x in enumerate(values)}
    assert e.find(asked).tolist() == [at.get(int(x), -1) for x in asked]


def test_trie(tmp_path):
    rng = np.random.default_rng(1)
    pairs = np.unique(np.stack([rng.integers(0, 50, 3000), rng.integers(0, 900, 3000)], 1), axis=0).astype(np.uint64)
    context, word = pairs[:, 0].copy(), pairs[:, 1].copy()
    codes = rng.integers(1, 60_000, len(context)).astype(np.uint16)
    elias_fano.Trie.of(context, word, codes).save(f"file://{tmp_path}/a.trie")
    trie = elias_fano.Trie.load(f"file://{tmp_path}/a.trie")
    known = {(int(a), int(b)): int(c) for a, b, c in zip(context, word, codes, strict=True)}
    asked_c, asked_w = rng.integers(0, 60, 5000).astype(np.uint64), rng.integers(0, 1000, 5000).astype(np.uint64)
    assert trie.lookup(asked_c, asked_w).tolist() == [known.get((int(a), int(b)), 0) for a, b in zip(asked_c, asked_w, strict=True)]
    p = elias_fano.dequantise(codes)
    assert abs(trie.mass(np.array([7], np.uint64))[0] - p[context == 7].sum()) < 1e-9
    assert abs(elias_fano.dequantise(elias_fano.quantise(np.array([0.3])))[0] / 0.3 - 1) < 0.003
