"""Exact, near and line dedup."""

import hashlib
import random
import re
import time

import numpy as np
import xxhash
from pyspark.sql import functions as F

from amberline.llm import grace_dedup, line_dedup, simhash


def keyed(rows):
    return sorted((tuple(r) for r in rows), key=str)


def want_exact(docs):
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    groups = {}
    for i, t in rows:
        groups.setdefault(t, []).append(i)
    out = []
    for i, t in rows:
        known = [x for x in groups[t] if x is not None]
        keep = max(known) if known else None
        out.append((i, keep, len(groups[t]), i == keep, hashlib.sha256(t.encode()).hexdigest(), groups[t].count(keep)))
    return keyed(out)


def test_exact(documents, odd):
    for docs in (documents, odd, documents.where("false")):
        got = keyed(grace_dedup.membership(docs).collect())
        want = want_exact(docs)
        single = {r[:5] for r in got}
        assert single == {r[:5] for r in want} and len(got) == len(want)


def test_exact_with_spill_files(spark, documents):
    many = documents.unionByName(documents.withColumn("doc_id", F.col("doc_id") + 1000)).unionByName(documents.limit(1).crossJoin(spark.range(300)).withColumn("doc_id", F.col("id") + 5000).drop("id"))
    assert keyed(r[:5] for r in grace_dedup.membership(many, table_bytes=20_000).collect()) == keyed(r[:5] for r in want_exact(many))


def test_exact_survivors(odd):
    left = grace_dedup.survivors(odd)
    assert left.columns == odd.columns
    got = sorted((r.doc_id, (r.text or "")[:20]) for r in left.collect() if r.doc_id is not None)
    assert got == [(2, "a b c d"), (4, ""), (5, "Łódź\n\nŁódź naïve 日本 "[:20]), (6, "other text of the sa"), (6, "word word word word "), (7, "z" * 20), (8, "!?")]
    assert left.where("doc_id IS NULL").count() == 1


def test_survivors_of_rows_that_repeat_everything(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (1, "a"), (0, "a"), (2, "b")], "doc_id long, text string")
    assert keyed(grace_dedup.survivors(docs).collect()) == [(1, "a"), (2, "b")]


def slow_fingerprint(text):
    data = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    words = re.findall(rb"[^\x20\x09-\x0D]+", data)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def want_components(prints):
    arr, root = np.array(prints, np.uint64), list(range(len(prints)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(arr ^ arr[i]) <= 3):
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_near(documents, odd):
    for docs in (documents, odd, documents.where("false")):
        rows = docs.select("doc_id", "text").collect()
        prints = [slow_fingerprint(r.text) for r in rows]
        roots = want_components(prints)
        least = {}
        for r, c in zip(rows, roots, strict=True):
            if r.doc_id is not None:
                least[c] = min(least.get(c, r.doc_id), r.doc_id)
        got = [(r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.membership(docs).collect()]
        assert keyed(got) == keyed((r.doc_id, p, least.get(c)) for r, p, c in zip(rows, prints, roots, strict=True))


def test_links_of_crowded_lists(spark):
    rng = np.random.default_rng(7)
    centres = rng.integers(0, 1 << 63, 5, dtype=np.uint64)
    prints = set()
    for c in centres:
        at = int(c)
        for _ in range(150):  # walks of few bits, so that components are long and lists are crowded
            for b in rng.integers(0, 64, int(rng.integers(1, 4))):
                at ^= 1 << int(b)
            prints.add(at)
    prints = sorted(prints)
    fps = np.array(prints, np.uint64).view(np.int64)
    df = spark.createDataFrame([(int(x),) for x in fps], "fp long")
    links = simhash.links(df).collect()
    assert len(links) < 14 * len(prints)
    root = {int(x): int(x) for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        assert bin((a ^ b) & (1 << 64) - 1).count("1") <= 3
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = want_components(prints)
    mine = [find(int(x)) for x in fps]
    assert len(set(zip(mine, want, strict=True))) == len(set(mine)) == len(set(want))


def linked(links, fps):
    root = {int(x): int(x) for x in fps}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        assert bin((a ^ b) & (1 << 64) - 1).count("1") <= 3
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(int(x)) for x in fps]


def test_crowded_lists_are_dealt_out(spark, monkeypatch):
    """Thousands of fingerprints that agree in four bytes: nothing is lost when their lists are split."""
    monkeypatch.setattr(simhash, "CROWDED", 40)
    monkeypatch.setattr(simhash, "IN_MEMORY", 20)
    rng = np.random.default_rng(11)
    base = int(rng.integers(0, 1 << 62))
    prints = {base ^ int(rng.integers(0, 1 << 18)) << 3 for _ in range(1500)} | {base ^ 1 << int(b) ^ 1 << int(c) for b, c in rng.integers(0, 64, (200, 2))}
    prints = sorted(p & (1 << 64) - 1 for p in prints)
    fps = np.array(prints, np.uint64).view(np.int64)
    want = want_components(prints)
    mine = linked(simhash.links(spark.createDataFrame([(int(x),) for x in fps], "fp long")).collect(), fps)
    assert len(set(zip(mine, want, strict=True))) == len(set(mine)) == len(set(want))
    mine = linked(simhash.cut_forest(np.array(prints, np.uint64)), prints)
    assert len(set(zip(mine, want, strict=True))) == len(set(mine)) == len(set(want))


def test_near_survivors(spark, odd):
    text = " ".join(f"word{i}" for i in range(3000))
    docs = spark.createDataFrame([(5, text), (3, text + " tail"), (4, "quite another text of its own here"), (9, "")], "doc_id long, text string")
    comps = {r.doc_id: r.component_id for r in simhash.membership(docs).collect()}
    assert {r.doc_id for r in simhash.survivors(docs).collect()} == set(comps.values())
    assert simhash.survivors(odd).columns == odd.columns


def test_lines(spark, odd):
    passage = "alpha one two three\nbeta four five six seven\ngamma eight nine ten"
    rows = [(1, f"{passage}\nhead"), (2, f"intro x\n{passage}\nout"), (3, "head\nbeta four five six seven\nnew"), (4, None), (None, "alpha one two three"), (5, ""), (6, f"{passage}\n\nmine\n{passage}")]
    got = {r.doc_id: (r.n_lines, r.n_removed, r.words_removed, r.text) for r in line_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == (4, 0, 0, rows[0][1]) and got[2] == (5, 3, 13, "intro x\nout") and got[3][1] == 0 and got[4] == (0, 0, 0, "") and got[None][1] == 0
    assert got[6][:2] == (7, 6) and got[6][3] == "\nmine"
    out = line_dedup.deduplicate(odd).collect()
    assert len(out) == odd.count() and all(r.text == "" for r in out if r.n_removed == r.n_lines and r.n_lines == 1)


def test_lines_of_copies_and_order(spark):
    lines = [f"line number {i} with several words in it" for i in range(30)]
    rows = [(10, "\n".join(lines)), (11, "\n".join(lines)), (12, "\n".join(lines[::-1])), (13, "fresh start of this\n" + "\n".join(lines[5:15]) + "\nfresh end of this")]
    got = {r.doc_id: r for r in line_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[10].n_removed == 0 and got[11].n_removed == 30 and got[11].text == ""
    assert got[12].n_removed == 0  # in turned order only single lines align, too few words for a block
    assert got[13].n_removed == 10 and got[13].text == "fresh start of this\nfresh end of this"


def test_lines_copied_from_later_holders(spark):
    lines = [f"line number {i} with several words in it" for i in range(30)]
    turned = "\n".join(lines[::-1])
    long = [f"{i} is a line of quite enough words to be a passage by itself" for i in range(4)]
    rows = [(10, "\n".join(lines)), (12, turned), (14, turned), (15, "own\n" + "\n".join(lines[20:9:-1]) + "\nend"), (16, f"{lines[3]}\nown words\n{lines[9]}"), (20, "\n".join(long)), (21, f"{long[2]}\nx\n{long[1]}\ny\n{long[0]}")]
    got = {r.doc_id: r for r in line_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[10].n_removed == got[12].n_removed == got[16].n_removed == got[20].n_removed == 0
    assert got[14].n_removed == 30 and got[14].text == ""
    assert got[15].n_removed == 11 and got[15].text == "own\nend"
    assert got[21].n_removed == 3 and got[21].text == "x\ny"


def want_lines(docs, least=10):
    """Every pair of documents, every maximal run of lines that both have: what is left of each document's lines."""
    rows = sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0))
    lines = [[x for x in (t or "").split("\n") if x.strip(" ")] for _, t in rows]
    out = {}
    for d, own in enumerate(lines):
        gone = set()
        for other in lines[:d]:
            places = {}
            for j, x in enumerate(other):
                places.setdefault(x, []).append(j)
            for i, x in enumerate(own):
                for j in places.get(x, ()):
                    if i and j and own[i - 1] == other[j - 1]:
                        continue
                    n = 0
                    while i + n < len(own) and j + n < len(other) and own[i + n] == other[j + n]:
                        n += 1
                    if sum(line_dedup.weight(y) for y in own[i : i + n]) >= least:
                        gone |= set(range(i, i + n))
        out[rows[d][0]] = (len(own), len(gone), sum(len(own[i].split()) for i in gone))
    return out


def got_lines(df):
    return {r.doc_id: (r.n_lines, r.n_removed, r.words_removed) for r in line_dedup.deduplicate(df).collect()}


def test_lines_against_all_pairs(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    want = want_lines(rows)
    assert got_lines(documents) == want and sum(n for _, n, _ in want.values()) > 20
    rng = random.Random(3)
    for words, vocabulary, size in ((3, 6, 12), (5, 12, 25), (2, 3, 40)):
        pool = [" ".join([f"w{i}"] * rng.randint(1, 2 * words)) for i in range(vocabulary)]
        rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.8 else f"own {i} {k}" for k in range(rng.randint(0, size)))) for i in range(60)]
        rows += [(100 + i, rows[i * 3][1]) for i in range(10)]
        assert got_lines(spark.createDataFrame(rows, "doc_id long, text string")) == want_lines(rows)


def test_lines_of_common_passages(spark, monkeypatch):
    """Passages of many holders, dealt over several tasks, beside those of few."""
    monkeypatch.setattr(line_dedup, "SHARE", 7)
    passage = [f"common line {i} of the notice" for i in range(4)]
    rows = [(i, "\n".join([f"own start {i}", *passage[i % 2 :], f"own middle {i}", *(passage if i % 3 == 0 else passage[::-1]), f"shared by few {i // 3} with ten words in this line here"])) for i in range(60)]
    assert got_lines(spark.createDataFrame(rows, "doc_id long, text string")) == want_lines(rows)


def test_lines_that_are_no_block(spark):
    lead = "a line of ten words that stands first in both here"
    earlier = "\n".join([lead, "b one", "c two", "d three", "Read more", "f five", "Read more"])
    later = "\n".join([lead, "Read more", "n new line", "Read more"])
    z, p, q, x, y = (f"{c} is one of the lines of twelve words in these three texts" for c in "zpqxy")
    df = spark.createDataFrame([(1, earlier), (2, later), (11, "\n".join([z, p, q, x])), (12, "\n".join([x, y, z])), (13, "\n".join([x, y, z]))], "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.deduplicate(df).collect()}
    assert got[2].n_removed == 1 and got[2].text == "\n".join(later.split("\n")[1:])
    assert got[12].n_removed == 2 and got[12].text == y and got[13].n_removed == 3


def test_lines_of_scripts_without_spaces(spark):
    passage = "\n".join(["吾輩は猫である。名前はまだ無い。", "どこで生れたかとんと見当がつかぬ。"])
    df = spark.createDataFrame([(1, f"{passage}\n一"), (2, f"二\n{passage}"), (3, "二\n一")], "doc_id long, text string")
    assert got_lines(df) == {1: (3, 0, 0), 2: (3, 2, 2), 3: (2, 0, 0)}
    assert line_dedup.deduplicate(df.where("false")).count() == 0


def test_repeated_lines_take_linear_time():
    def took(n):
        lines = [f"line {i % 50} of six words each" for i in range(n)]
        digests = [f"{i % 50:016d}".encode() for i in range(n)]
        start = time.process_time()
        weights = [line_dedup.weight(x) for x in lines]
        earlier = line_dedup.Earlier(b"".join(digests[:100]), weights[:100], 10)
        runs = [(s, b"".join(digests[s:e])) for s, e in line_dedup.shortest_runs(weights, 10)]
        assert len(earlier.align(runs)) == n
        return time.process_time() - start

    took(10_000)
    assert took(80_000) < 8 * took(20_000)


def test_rising():
    assert line_dedup.rising([3, 1, 2, 5, 4]) in ([1, 2, 3], [1, 2, 4]) and line_dedup.rising([]) == []


def test_survivors_with_spill_files(spark, documents):
    many = documents.unionByName(documents.withColumn("doc_id", F.col("doc_id") + 1000)).unionByName(documents.limit(1).crossJoin(spark.range(500)).withColumn("doc_id", F.col("id") + 5000).drop("id"))
    want = {r[1] for r in want_exact(many)}
    for table_bytes in (20_000, 64 << 20):
        got = grace_dedup.survivors(many, table_bytes=table_bytes).collect()
        assert sorted(r.doc_id for r in got) == sorted(want) and got[0].__fields__ == many.columns


def test_survivors_under_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a", 5), (2, "a", 6), (3, None, 7)], "_id long, _h string, x long")
    assert keyed(grace_dedup.survivors(docs, "_id", "_h").collect()) == [(2, "a", 6), (3, None, 7)]
