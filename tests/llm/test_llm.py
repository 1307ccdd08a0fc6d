"""The corpus operators against brute force, on rows with nulls, ties, repeats and clashing column names."""

import collections
import hashlib
import math
import random
import subprocess
import sys
import tracemalloc
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from trailmark.llm import decontaminate, fingerprint, katz, langid, packing, preferences, quality, simhash, substrings, warc

RNG = random.Random(3)
VOCABULARY = ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randint(1, 6))) for _ in range(60)]
PASSAGE = " ".join(VOCABULARY[:20])
EXTRA = "doc_id long, text string, lang string, `table` string, bucket long, id string, key string, h string"


def made_rows():
    texts = [" ".join(RNG.choice(VOCABULARY) for _ in range(RNG.randint(1, 80))) for _ in range(40)]
    texts += [PASSAGE + " " + texts[0], texts[1] + "\n" + PASSAGE, texts[2], texts[2] + " z", "", None, "one two three", "x " * 3000, "Ünï çødé\x1c" * 20]
    found = [(i * 3, t, "en", "t", i, "i", "k", "h") for i, t in enumerate(texts)]
    return found + [found[5], (None, "null id " + PASSAGE, None, None, None, None, None, None)]


ROWS = made_rows()


def rows():
    return list(ROWS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), EXTRA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], EXTRA)


def words(t):
    return (t or "").encode().split()


@pytest.mark.parametrize("spread", [True, False])
def test_katz_equals_brute_force(spark, docs, empty, monkeypatch, spread):
    """With frequent words spread over tables and without."""
    often = {xxhash.xxh64_intdigest(w): 3 for w in (b"x", VOCABULARY[0].encode(), VOCABULARY[1].encode())} | {int(katz.BEGIN): 2}
    monkeypatch.setattr(katz, "spread_words", lambda docs, tables: often if spread else {})
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    every = [(r[0], ["B", "B", *[x.lower() for x in words(r[1])], b"END"]) for r in rows()]
    grams = {n: collections.Counter(tuple(w[i - n + 1 : i + 1]) for i, w in ((i, w) for doc, w in every if not held(doc) for i in range(2, len(w)))) for n in (1, 2, 3)}
    d = {n: katz.discounts([sum(v == r for v in grams[n].values()) for r in range(7)]) for n in grams}
    cut = lambda n, c: c * (d[n][c] if c < 6 else 1)
    total = sum(grams[1].values())
    left = {n: collections.defaultdict(list) for n in (2, 3)}
    for n in left:
        for g, c in grams[n].items():
            left[n][g[:-1]].append((g[-1], c))
    memo = {}

    def p(h, w):
        n = len(h) + 1
        if n == 1:
            mass = sum(cut(1, c) for c in grams[1].values())
            over = total if mass < total * (1 - 1e-12) else total + 1
            return cut(1, grams[1][w,]) / over if grams[1][w,] else 1 - mass / over
        if h not in memo:
            c, mass = sum(x for _, x in left[n][h]), sum(cut(n, x) for _, x in left[n][h])
            over = c if mass < c * (1 - 1e-12) else c + 1
            memo[h] = (over, (1 - mass / over) / (1 - sum(p(h[1:], x) for x, _ in left[n][h])) if c else 1.0)
        over, alpha = memo[h]
        return cut(n, grams[n][*h, w]) / over if grams[n][*h, w] else alpha * p(h[1:], w)

    for h in [("B", "B"), *list(left[3])[:20]]:
        assert sum(p(h, w) for (w,) in grams[1]) + p(h, b"unknown") == pytest.approx(1, abs=1e-9)
    want = sorted((-1 if i is None else i, len(w) - 2, sum(grams[1][x,] > 0 for x in w[2:]), round(sum(math.log10(p(tuple(w[j - 2 : j]), w[j])) for j in range(2, len(w))), 6)) for i, w in every)
    got = katz.score_documents(docs).collect()
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"], r["n_known"], round(r["score"], 6)) for r in got) == want
    assert {r["train_tokens"] for r in got} == {total}
    assert katz.score_documents(empty).count() == 0


def test_katz_spreads_frequent_words(spark):
    d = spark.createDataFrame([(i, "often " * 50 + f"rare{i} word{i}") for i in range(200)], "doc_id long, text string")
    got = katz.spread_words(d, 10)
    assert got[xxhash.xxh64_intdigest(b"often")] == 10 and len(got) <= 10


def test_katz_workers_give_memory_back():
    """What a worker holds of large arrays goes when they are freed, also after larger ones were freed before."""
    script = """
import re
import numpy as np
from trailmark.llm import common, katz

def held():
    return int(re.search(r"VmRSS:\\s+(\\d+)", open("/proc/self/status").read()).group(1)) / 1024

def work():
    np.ones(30 << 20, np.uint8)
    large = [np.ones(5 << 20, np.uint8) for _ in range(20)]
    keep = np.ones(2 << 20, np.uint8)
    before = held()
    del large
    return before - held()

print(katz.lean(work), next(katz.leanly(lambda batches: iter([work()]))(None)))
"""
    got = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, cwd=Path(katz.__file__).parents[2], check=True).stdout
    assert all(float(x) > 90 for x in got.split()) and got


def test_katz_workers_work_in_pieces(monkeypatch):
    """What sending, merging and scoring hold besides their input grows little with a batch; pieces change nothing."""
    import pyspark

    class Context:
        get = classmethod(lambda cls: cls)
        partitionId = staticmethod(lambda: 0)

    monkeypatch.setattr(pyspark, "TaskContext", Context)
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.3, 200) % 20000) for _ in range(1500)]
    docs = pa.RecordBatch.from_pydict({"doc_id": range(len(texts)), "text": texts})
    held = {}

    def most(name, function):
        tracemalloc.start()
        got = function()
        held[name] = tracemalloc.get_traced_memory()[1] / (201 * len(texts))
        tracemalloc.stop()
        return got

    def run(piece):
        monkeypatch.setattr(katz, "PIECE", piece, raising=False)
        sent = pa.Table.from_batches(most("send", lambda: list(katz.send(iter([docs]), 40, 10, {}))))
        sent = sent.set_column(sent.schema.get_field_index("table"), "table", pa.array([-1] + [0] * (len(sent) - 1)))  # all triples in one table
        merged = most("merge", lambda: katz.merge(sent.slice(1)))
        model = katz.Words([0, 9, 5, 3, 2, 1, 1], 300000, 20000)

        def score():
            r = katz.Round({k: v[0].as_py() for k, v in zip(merged.schema.names, merged.columns)}, [], 4, model, np.ones(6), np.ones(6), {})
            r.with_b()
            return r.probabilities()

        return sent, merged, most("score", score)

    whole, parts = run(1 << 30), run(1 << 14)
    assert whole[0].equals(parts[0]) and whole[1].equals(parts[1]) and (whole[2] == parts[2]).all()
    assert held["send"] < 55 and held["merge"] < 45 and held["score"] < 45, held


def test_warc_round_trip(spark, docs, tmp_path):
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("http://x/ y\r\n").alias("url"), F.col("text").alias("html"), "key")
    archives = warc.write_archives(pages)
    got = warc.read_archives(archives).collect()
    assert not [r["error"] for r in got if r["error"]] and len(got) == len(rows())
    by = collections.defaultdict(list)
    for i, t, *_ in rows():
        by[(t or "").encode()].append(-1 if i is None else i)
    for r in got:
        own = next(b for b in by if warc.sha1_base32(b) == r["payload_digest"])
        assert r["payload_bytes"] == len(own)
        assert r["payload"] == own if r["record_type"] == "response" else r["refers_to"] == max(by[own])
    assert collections.Counter(r["record_type"] for r in got)["response"] == len(by)
    content = archives.first()["content"]
    (tmp_path / "a.warc.zst").write_bytes(content)
    files = spark.read.format("binaryFile").load(str(tmp_path))
    assert warc.read_archives(files).count() == len(list(warc.frames(content)))
    broken = spark.createDataFrame([(bytearray(content[:-9]),), (bytearray(b"nothing"),), (None,)], "content binary")
    assert warc.read_archives(broken).where("error is not null").count() == 3
    record = next(iter(warc.frames(content)))
    for bad in (record.replace(b"Content-Length: ", b"Content-Length: 9", 1), record.replace(b"WARC/1.1", b"HTTP/1.1", 1), record[:-2], record.replace(b"WARC-Date", b"WARC-Gate")):
        with pytest.raises(ValueError):
            warc.parse(bad)


def foreign(kind, block, **fields):
    head = {"WARC-Type": kind, "WARC-Record-ID": "<urn:uuid:0000>", "WARC-Date": "2020-01-01T00:00:00Z", **fields, "Content-Length": len(block)}
    return "\r\n".join(["WARC/1.0", *(f"{k.replace('_', '-')}: {v}" for k, v in head.items())]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_warc_reads_records_of_others(spark):
    body = b"some body " * 30
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + b"a;x=y\r\n" + body[:10] + b"\r\n" + b"%x\r\n" % (len(body) - 10) + body[10:] + b"\r\n0\r\n\r\n"
    bare = b"HTTP/1.1 200 OK\r\n\r\n" + body
    records = [foreign("warcinfo", b"software: x\r\n", Content_Type="application/warc-fields"), foreign("request", b"GET / HTTP/1.1\r\nHost: x\r\n\r\n"), foreign("response", chunked, WARC_Payload_Digest="sha1:" + warc.sha1_base32(body)), foreign("response", bare), foreign("metadata", b"a: b"), foreign("resource", body, Content_Type="text/plain"), foreign("revisit", b"", WARC_Refers_To="<urn:uuid:1>"), foreign("response", chunked.replace(b"a;x=y", b"zz"))]
    archive = spark.createDataFrame([(bytearray(warc.pack(records)),)], "content binary")
    got = warc.read_archives(archive).collect()
    assert [r["record_type"] for r in got] == ["warcinfo", "request", "response", "response", "metadata", "resource", "revisit", None]
    assert [bytes(r["payload"]) for r in got[2:6]] == [body, body, b"a: b", body] and got[6]["refers_to_id"] == "<urn:uuid:1>" and got[0]["record_id"] == "<urn:uuid:0000>"
    assert [r["error"] for r in got] == [None] * 7 + ["a chunk without a size"] and all(r["page_id"] is None for r in got)
    with pytest.raises(ValueError, match="digest"):
        warc.parse(foreign("response", bare, WARC_Payload_Digest="sha1:" + warc.sha1_base32(b"x")))


def test_warc_of_nothing_and_of_much(spark, tmp_path):
    kind = "page_id long, url string, html string, holder string, _row long"
    assert warc.read_archives(warc.write_archives(spark.createDataFrame([], kind))).count() == 0
    rng = random.Random(12)
    long = "".join(rng.choice("abcdefgh ") for _ in range(9 << 20))
    pages = spark.createDataFrame([(1, "u", long, "h", 5), (2, "u", long, "h", 5), (3, "u", "short", "h", 5), (3, "u", "short", "h", 5), (None, "u", "short", "h", 5)], kind)
    archives = warc.write_archives(pages)
    got = warc.read_archives(archives).collect()
    assert sorted((str(r["page_id"]), r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got) == [("1", "revisit", 2, len(long)), ("2", "response", None, len(long)), ("3", "response", None, 5), ("3", "revisit", 3, 5), ("None", "revisit", 3, 5)]
    warc.export_archives(archives, tmp_path.as_uri())
    warc.export_archives(archives, tmp_path.as_uri())
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(str(tmp_path))
    assert files.count() == archives.count() and warc.read_archives(files, payloads=False).where("error is null").count() == 5


def test_document_frequencies_are_of_all_rows(spark):
    texts = ["abc abd", "abc", "", None, "12", "abc abc"]
    n, df = langid.document_frequencies(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    want = sum((langid.counts(t) > 0).astype(int) for t in ("abc abd", "abc", "abc abc"))
    assert n == 3 and (df == want).all()


def test_language_ids(spark, empty):
    make = {"aa": "abcd", "bb": "wxyz"}
    rng = random.Random(1)
    made = [(i, " ".join("".join(rng.choice(make[lang]) for _ in range(5)) for _ in range(30)), lang) for i, lang in enumerate(["aa", "bb"] * 60)]
    d = spark.createDataFrame([*made, (900, None, "aa"), (901, "12 34", None), (None, "abca bcda", None)], "doc_id long, text string, lang string")
    model = langid.fit(d)
    got = {r["doc_id"]: r for r in langid.identify(d, model, ["doc_id", "lang"]).collect()}
    assert all(got[i]["lang_pred"] == lang and not got[i]["rejected"] for i, _, lang in made)
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und" and got[901]["rejected"] and got[None]["lang_pred"] == "aa"
    nothing = langid.fit(empty)
    assert langid.identify(d, nothing, ["doc_id"]).where("lang_pred <> 'und'").count() == 0


def test_unlearned_languages_are_rejected(spark):
    parts = {"aa": "the and ing er on at is".split(), "bb": "der und ung sch ein ich en".split(), "cc": "que los ado ente cio por la".split()}
    rng = random.Random(4)

    def text(lang, n):
        return " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))

    learned = [(i, text(lang, rng.choice([2, 8, 40, 200])), lang) for i, lang in enumerate(["aa", "bb"] * 100)]
    stray = [(900, text("cc", 200), "aa")]
    new = [(1000 + i, text(lang, 40), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 40)]
    schema = "doc_id long, text string, lang string"
    model = langid.fit(spark.createDataFrame(learned + stray, schema))
    got = langid.identify(spark.createDataFrame(new + learned, schema), model, ["doc_id", "lang"]).collect()
    assert sum(r["rejected"] for r in got if r["lang"] == "cc") >= 39
    known = [r for r in got if r["lang"] != "cc"]
    assert sum(r["rejected"] for r in known) <= 3 and sum(r["lang_pred"] != r["lang"] for r in known) <= 3


def brute_windows(table):
    first = {}
    for i, t in table:
        w = words(t)
        for j in range(len(w) - 12):
            k = tuple(w[j : j + 13])
            first[k] = min(first.get(k, i), i)
    out = []
    for i, t in table:
        w = words(t)
        lost = {x for j in range(len(w) - 12) if first[tuple(w[j : j + 13])] < i for x in range(j, j + 13)}
        out.append((i, len(w), len(lost), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in lost)).hexdigest()))
    return sorted(out)


def test_substrings_equal_brute_force(docs, empty, monkeypatch):
    table = [(substrings.NO_ID if r[0] is None else r[0], r[1]) for r in rows()]
    got = substrings.remove_repeats(docs, ["doc_id"], texts=False).collect()
    assert sorted((substrings.NO_ID if r[0] is None else r[0], *r[1:]) for r in got) == brute_windows(table)
    assert substrings.remove_repeats(empty, ["doc_id"]).count() == 0


def test_ranked_groups_agree_with_hashed():
    ids = np.random.default_rng(1).integers(0, 2, 400)
    at = np.arange(len(ids) - 12)
    a, b = substrings.window_groups(ids, at), substrings.ranked_groups(ids, at)
    assert len(set(zip(a.tolist(), b.tolist()))) == len(set(a.tolist())) == len(set(b.tolist()))


def brute_fingerprint(t):
    w = [x.lower() for x in words(t)]
    if not w:
        return 0
    k = min(4, len(w))
    h = [xxhash.xxh64_intdigest(b" ".join(w[j : j + k]), 42) for j in range(len(w) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("most", [4096, 3])
def test_simhash_components(spark, most):
    rng = random.Random(7)
    centre = rng.getrandbits(64)
    prints = {centre, 0, 1 << 63} | {rng.getrandbits(64) for _ in range(50)}
    for _ in range(60):  # chains of near fingerprints
        x = rng.choice(sorted(prints))
        for b in rng.sample(range(64), rng.randint(1, 5)):
            x ^= 1 << b
        prints.add(x)
    signed = lambda x: x - (1 << 64) * (x >> 63)
    classes = spark.createDataFrame([(signed(x),) for x in prints], "fp long")
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(classes, most=most)).collect()}
    order = sorted(prints)
    parent = {x: x for x in order}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for i, a in enumerate(order):
        for b in order[:i]:
            if (a ^ b).bit_count() <= 4:
                parent[find(a)] = find(b)
    groups = lambda name: sorted(sorted(g) for g in (lambda d: [d.setdefault(name(x), []).append(x) for x in order] and d.values())({}))
    assert groups(find) == groups(lambda x: roots.get(signed(x), signed(x)))


def test_simhash_documents(docs, empty):
    got = simhash.near_duplicates(docs).collect()
    table = [(r[0], brute_fingerprint(r[1])) for r in rows()]
    assert sorted((str(r["doc_id"]), r["fingerprint"]) for r in got) == sorted((str(i), f"{f:016x}") for i, f in table)
    same = {r["doc_id"]: r["component_id"] for r in got}
    assert same[3 * 44] == same[3 * 45] == 3 * 44  # empty and null
    assert same[3 * 42] == 6
    assert simhash.near_duplicates(empty).count() == 0


def test_near_dedup_stage_keeps_one_row_of_each_group(spark, empty):
    import corpus_pipeline

    rng = random.Random(5)
    a, b, c, d, e = (" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(200)) for _ in range(5))
    made = [(5, a, "p"), (5, a, "q"), (9, a, "p"), (None, b, "p"), (None, b, "p"), (None, c, "p"), (7, c, "p"), (7, d, "p"), (3, d, "p"), (2, e, "p"), (2, e.upper(), "p"), (1, None, "p"), (None, "", "p")]
    docs = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in made], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.simhash_near_dedup(spark, docs, "")
    assert got.columns == corpus_pipeline.COLUMNS
    got = sorted(((r["doc_id"], (r["text"] or "").lower(), r["source"]) for r in got.collect()), key=str)
    assert got == sorted([(5, a, "p"), (None, b, "p"), (7, c, "p"), (3, d, "p"), (2, e, "p"), (1, "", "p")], key=str)
    assert corpus_pipeline.simhash_near_dedup(spark, docs.limit(0), "").count() == 0


def test_near_dedup_stage_finds_copies_of_similarity_08(spark):
    import corpus_pipeline

    rng = random.Random(6)
    made = []
    for g in range(60):
        w = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(104)]
        near, far = list(w), list(w)
        near[50] = near[20] = "x"  # 90 of 110 shingles
        for at in range(5, 100, 10):
            far[at] = "y"
        made += [(10 * g, " ".join(w)), (10 * g + 1, " ".join(near)), (10 * g + 2, " ".join(far))]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in made], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"] for r in corpus_pipeline.simhash_near_dedup(spark, docs, "").collect()}
    assert got == {i for i, _ in made if i % 10 != 1}


@pytest.mark.parametrize("most", [1024, 8])
def test_near_dedup_stage_compares_all_sets_of_a_bucket(spark, monkeypatch, most):
    """All sets in one bucket, chains of three where the ends are unlike; with blocks of the bucket and without."""
    import corpus_pipeline
    from trailmark.llm import similar

    monkeypatch.setattr(similar, "bands_of", lambda hashes: [1] if len(hashes) else [])
    monkeypatch.setattr(similar, "MOST", most, raising=False)
    rng = random.Random(8)
    made = []
    for g in range(20):
        w = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(104)]
        for i in range(3):
            made.append((10 * g + i, " ".join(w)))
            w[20 + 5 * i] = w[60 + 5 * i] = f"x{i}"  # 90 of 110 shingles are common to neighbours
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in made], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"] for r in corpus_pipeline.simhash_near_dedup(spark, docs, "").collect()}
    assert got == {10 * g for g in range(20)}


STAGED = "doc_id long, text string, lang string, source string, n_chars long, bucket string"


def test_language_and_substring_stages(spark):
    """Each stage on rows with nulls, empties, repeats, null ids and an extra column, against brute force."""
    import corpus_pipeline

    rng = random.Random(20)
    parts = {"aa": "the and ing er on at is".split(), "bb": "der und ung sch ein ich en".split()}
    text = lambda lang, n: " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    rows = [(i, text(lang, 60), lang, "s", 0, "b") for i, lang in enumerate(["aa", "bb"] * 60)]
    rows += [rows[3], (None, text("aa", 60), None, "s", 0, "b"), (900, None, "aa", "s", 0, "b"), (901, "", "aa", "s", 0, "b"), (902, "12 34 ...", None, "s", 0, "b"), (903, "\u0434\u043e\u043c " * 60, None, "s", 0, "b")]
    d = spark.createDataFrame(rows, STAGED)
    got = corpus_pipeline.language_id(spark, d, "").collect()
    kept = collections.Counter((r["doc_id"], r["text"]) for r in got)
    assert kept[3, rows[3][1]] == 2 and all((i, None if t is None else t) not in kept for i, t, *_ in rows if i in (900, 901, 902, 903))
    assert sum(kept.values()) >= 118 and [r["lang"] for r in got if r["doc_id"] is None] == ["aa"]
    shared = " ".join(f"w{i}" for i in range(60))
    rows = [(1, "one " + shared + " two", "aa", "s", 5, "b"), (2, "three  " + shared + " four", "aa", "s", 6, "b"), (None, shared, "aa", "s", 7, "b"), (4, "short", "aa", "s", 8, "b"), (5, None, "aa", "s", 9, "b"), (5, "short", "aa", "s", 9, "b")]
    d = spark.createDataFrame(rows, STAGED)
    got = corpus_pipeline.substring_dedup(spark, d, "").collect()
    # the null id comes last, so it loses its whole text and goes; texts that lose nothing stay as they are
    want = [("1", rows[0][1], 5), ("2", "three four", 10), ("4", "short", 8), ("5", None, 9), ("5", "short", 9)]
    assert sorted(((str(r["doc_id"]), r["text"], r["n_chars"]) for r in got), key=str) == sorted(want, key=str)


def test_decontamination_and_packing_stages(spark, tmp_path):
    import corpus_pipeline
    import tokenizers

    item = "the train to the big city leaves with 12 boxes and 13 tons of rope from near the old harbour wall"
    rows = [(1, "before it. " + item, "aa", "s", 0, "b"), (1, "a clean row of the same id", "aa", "s", 0, "b"), (None, item, "aa", "s", 0, "b"), (None, "clean without an id", "aa", "s", 0, "b"), (4, None, "aa", "s", 0, "b"), (5, "", "aa", "s", 0, "b"), (6, "x " * 9000, "aa", "s", 0, "b"), (6, "x " * 9000, "aa", "s", 0, "b")]
    d = spark.createDataFrame(rows, STAGED)
    spark.createDataFrame([(10, item, "x"), (None, "never read", "x")], "item_id long, text string, doc_id string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.benchmark_decontamination(spark, d, str(tmp_path))
    assert got.columns == corpus_pipeline.COLUMNS
    want = [(i, t) for i, t, *_ in rows if not (t and item in t)]
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted(want, key=str)
    pieces = corpus_pipeline.packing_stage(spark, got, "").collect()
    t = tokenizers.Tokenizer.from_file(packing.tokenizer_path())
    assert sum(r["length"] for r in pieces) == sum(len(t.encode(x or "", add_special_tokens=False).ids) + 1 for _, x in want)
    assert collections.Counter(r["doc_id"] for r in pieces if r["start"] == 0)[6] == 2


def test_pipeline_end_to_end(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(21)
    parts = "the and ing er on at is".split()
    text = lambda n: " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))
    rows = [(i, text(80), "aa", "s", 0) for i in range(60)]
    rows += [(100, rows[0][1], "aa", "s", 0), (101, None, "aa", "s", 0)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, rows[5][1])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert 100 not in got and 101 not in got and 5 not in got and len(got) >= 57


def test_language_id_of_held_out_rows(spark):
    """Learned from some rows, held against others; extra columns, repeats and a very long text change nothing."""
    parts = {"aa": "the and ing er on at is".split(), "bb": "der und ung sch ein ich en".split()}
    rng = random.Random(14)
    text = lambda lang, n: " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    rows = [(i, text(lang, rng.choice([5, 30, 200])), lang, "x", 0.5, True) for i, lang in enumerate(["aa", "bb"] * 150)]
    rows += [rows[0], rows[0], (900, text("bb", 200_000), "bb", "x", 0.5, True), (901, "", None, "x", 0.5, True)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double, rejected boolean")
    held = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i, *_ in rows}
    model = langid.fit(d.where(langid.fold_column("doc_id", 3) != 1))
    got = [r for r in langid.identify(d, model, ["doc_id", "lang"]).collect() if held[r["doc_id"]] and r["lang"]]
    assert len(got) > 80 and sum(r["lang_pred"] == r["lang"] for r in got) >= 0.98 * len(got)
    assert langid.identify(d, model, ["doc_id"]).where("doc_id = 0").count() == 3
    assert [r["lang_pred"] for r in langid.identify(d, model, ["doc_id"]).where("doc_id = 900").collect()] == ["bb"]


def test_nearest_centroid_equals_brute_force(spark):
    """Predictions are the centroid with the largest cosine, computed one text at a time."""
    rng = random.Random(15)
    made = [(i, " ".join("".join(rng.choice("abcdefg"[k:] + "xyz") for _ in range(4)) for _ in range(20)), f"l{k}") for i, k in enumerate([0, 3] * 40)]
    model = langid.fit(spark.createDataFrame(made, "doc_id long, text string, lang string"))
    names, score, _ = model.predict([t for _, t, _ in made])
    for (_, t, _), name, s in zip(made, names, score):
        v = np.log1p(langid.counts(t).astype(np.float64)) * model.idf
        near = model.centroids @ (v / np.linalg.norm(v))
        assert model.languages[int(near.argmax())] == name and s == pytest.approx(min(1, near.max()), abs=1e-4)


def test_quality_of_held_out_rows_and_the_prior(spark, empty):
    """Scores of rows that no label was learned from; a very long text, empties, repeats, ties and extra columns."""
    rng = random.Random(16)
    good = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega"]) + rng.choice(["", "s", "ed"]) for _ in range(n))
    bad = lambda n: " ".join(rng.choice(["win", "cash", "now", "click", "free"]) + rng.choice(["", "s", "ed"]) for _ in range(n))
    rows = [(i, good(40) if i % 5 else bad(40), "x", 0.5) for i in range(600)]
    d = spark.createDataFrame([*rows, rows[1], rows[1], (900, good(200_000), "x", 0.5), (901, None, "x", 0.5), (902, "", "x", 0.5), (None, good(30), "x", 0.5)], "doc_id long, text string, quality string, score double")
    labels = spark.createDataFrame([(i, int(i % 5 > 0), "t") for i in range(0, 600, 2)] + [(2, 1, "t")], "doc_id long, quality int, text string")
    got = {r["doc_id"]: r["score"] for r in quality.score(d, quality.fit(d, labels)).collect()}
    held = [i for i in range(1, 600, 2)]
    assert sum((got[i] >= quality.THRESHOLD) == (i % 5 > 0) for i in held) >= 0.97 * len(held)
    pos, neg = [got[i] for i in held if i % 5], [got[i] for i in held if not i % 5]
    assert sum(p > n for p in pos for n in neg) >= 0.99 * len(pos) * len(neg)
    assert got[900] > 0.5 and got[901] == got[902] and 0 <= got[902] <= 1
    only = quality.fit(d, labels.where("quality = 1"))
    assert only.prior == pytest.approx(0.8, abs=0.12)
    assert quality.score(empty, only).count() == 0 and quality.fit(empty, labels) is None
    # a bound is a bound, also where one text is all there is
    same = spark.createDataFrame([(None, "copy")] * 500, "doc_id long, text string")
    assert quality.sampled(same, 50, 1).count() <= 50


def test_quality(spark, empty):
    rng = random.Random(2)
    good = lambda: " ".join("".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(40)) + "."
    bad = lambda: " ".join(rng.choice(["$$$", "###", "BUY!!", "|||"]) for _ in range(40))
    made = [(i, bad() if i % 4 == 0 else good()) for i in range(400)]
    d = spark.createDataFrame([*made, (999, None), (None, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(0, 400, 3)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["score"] for r in quality.score(d, quality.fit(d, labels)).collect()}
    assert sum((got[i] >= 0.5) == (i % 4 > 0) for i, _ in made) >= 390 and 0 <= got[999] <= 1
    assert {r["score"] for r in quality.score(d, quality.fit(d, labels.limit(0))).collect()} == {0.5}


def test_fingerprints(docs, empty, spark):
    got = fingerprint.edited_fingerprints(docs).collect()
    table = sorted(((fingerprint.NO_ID if r[0] is None else r[0], r[1] or "") for r in rows()))
    after = table[1:] + table[:1]
    want = sorted((i, len(t), hashlib.sha256((t[: len(t) - len(t) // 2] + n[: len(t) // 2]).encode()).hexdigest()) for (i, t), (_, n) in zip(table, after))
    assert sorted((fingerprint.NO_ID if r["doc_id"] is None else r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert fingerprint.edited_fingerprints(empty).count() == 0
    lines = [f"line {i} of the text" for i in range(200)]
    a = spark.createDataFrame([(1, "\n".join(lines)), (2, "same"), (3, "only here")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "\n".join(lines[:50] + ["put in"] + lines[50:])), (2, "same")], "doc_id long, text string")
    found = fingerprint.differing(a, b).collect()
    # one line more changes the branch it falls into and no paragraph of the left side
    assert [(r["doc_id"], r["position"]) for r in found if r["side"] == "right" and r["part"] == "paragraph"] == [(1, 50)]
    assert not [r for r in found if r["side"] == "left" and r["part"] == "paragraph"] and 1 <= len([r for r in found if r["side"] == "left"]) <= 2


@pytest.mark.parametrize("text", ["", "a", "a\n", "\n\n", "no end\u2028", "x. y\x85", "ends\r\nso. on", "word " * 50 + "\n", "s" * 3000, None])
def test_paragraphs_hold_the_whole_text(spark, text):
    import re

    parts = spark.createDataFrame([(text,)], "text string").select(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(fingerprint.PARAGRAPH), F.lit(0))).first()[0]
    assert "".join(parts) == (text or "") and all(parts)


def test_likeness_is_the_share_of_common_nodes(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdesy.") for _ in range(4))
    made = [" ".join(word() for _ in range(n)) for n in (0, 1, 40, 3000, 20000)]
    changed = [t + " end." for t in made]
    d = spark.createDataFrame(list(enumerate(zip(made, changed))), "i int, t struct<a: string, b: string>")
    d = d.select("i", fingerprint.tree(F.col("t.a"))["tree"].alias("a"), fingerprint.tree(F.col("t.b"))["tree"].alias("b"))
    for r in d.select("*", fingerprint.likeness(F.col("a"), F.col("b")).alias("near"), fingerprint.likeness(F.col("a"), F.col("a")).alias("same")).collect():
        x, y = ({*r[k]["paragraphs"], *r[k]["sections"], r[k]["root"]} for k in "ab")
        assert r["near"] == pytest.approx(2 * len(x & y) / (len(x) + len(y))) and r["near"] < 1 == r["same"]


def test_packing(docs, empty):
    import tokenizers

    path = packing.tokenizer_path()
    t = tokenizers.Tokenizer.from_file(path)
    got = packing.pack_documents(docs, path, with_ids=True, group_tokens=3000).collect()
    whole, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]
        whole[r["doc_id"], r["doc_tokens"]].append((r["start"], r["ids"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"], r["sequence_length"]))
    ids = collections.Counter(tuple(x) for x in ([*t.encode(r[1] or "", add_special_tokens=False).ids, 0] for r in rows()))
    pieces = sum(r["length"] for r in got)
    assert pieces == sum(len(k) * n for k, n in ids.items())
    for (i, n), parts in whole.items():
        if sum(len(p) for _, p in parts) == n:
            assert tuple(x for _, p in sorted(parts) for x in p) in ids
    for parts in sequences.values():
        end = 0
        for offset, length, size in sorted(parts):
            assert offset == end
            end += length
        assert end == size and size & (size - 1) == 0 and size <= 1024
    assert packing.pack_documents(empty, path).count() == 0


def test_ids_are_those_of_tokenizers():
    import json

    import tokenizers

    definition = open(packing.tokenizer_path(), encoding="utf-8").read()
    rng = random.Random(9)
    odd = [chr(c) for c in (0xA7D4, 0xA7E2, 0xA7F1, 0x2028, 0x85, 0x1C, 0x200B, 0xB2, 0x2160, 0xE9, 0x301)]
    texts = ["".join(rng.choice([*odd, *"ab1 !'\n", "'s", "'t", " ", chr(rng.randrange(0xD800))]) for _ in range(30)) for _ in range(2000)]
    rules = json.loads(definition)
    for change in ({}, {"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {**rules["pre_tokenizer"], "add_prefix_space": True}}):
        own = json.dumps(rules | change)
        want = tokenizers.Tokenizer.from_str(own)
        got = packing.Encoder(own).encode(texts)
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [want.encode(t, add_special_tokens=False).ids for t in texts]


def test_step_groups_hold_one_length_and_bounded_tokens():
    rng = random.Random(10)
    pieces, sequences = packing.pack([rng.choice([3, 100, 700, 1500, 5000]) for _ in range(400)])
    groups = collections.defaultdict(list)
    for i, g in enumerate(packing.step_groups(pieces, sequences)):
        groups[g].append(sequences[i])
    assert all(len(set(v)) == 1 and sum(v) <= packing.STEP_TOKENS for v in groups.values())
    cost = collections.Counter()
    for _, _, n, s, _ in pieces:
        cost[s] += n * n
    full = [g for g, v in groups.items() if v[0] == 1024 and len(v) == 8]
    of = packing.step_groups(pieces, sequences)
    sums = [sum(c for s, c in cost.items() if of[s] == g) for g in full]
    assert max(sums) <= 1.3 * min(sums)


def test_leaks(spark, empty):
    item = "the train to the big City leaves with 12 boxes and 12 km of rope for Anna near the old harbour wall"
    other = item.replace("12", "40").replace("City", "Town").replace("Anna", "Maria")
    uneven = item.replace("12 boxes", "40 boxes")
    filler = "some words that come before it all. "
    d = spark.createDataFrame([(1, filler + item), (2, filler + other + ". More."), (3, filler + uneven), (4, filler * 5), (5, None), (6, ""), (None, item), (7, item.upper().replace("KM", "km"))], "doc_id long, text string")
    b = spark.createDataFrame([(10, item), (11, None), (12, "too short")], "item_id long, text string")
    got = {r["doc_id"]: r["reparameterised"] for r in decontaminate.leaks(d, b).collect()}
    assert got.get(1) is False and got.get(2) is True and 3 not in got and 4 not in got and got.get(None) is False and 7 in got
    assert {r["doc_id"]: r["reparameterised"] for r in decontaminate.leaks(d, b, most_broadcast=0).collect()} == got
    # rows of one id are judged apart: the copy counts, the other row takes nothing from it
    twice = spark.createDataFrame([(1, filler + item, "x"), (1, filler + uneven, "y"), (1, filler + other, "z"), (1, filler + item, "x")], "doc_id long, text string, item_id string")
    assert [(r["doc_id"], r["reparameterised"]) for r in decontaminate.leaks(twice, b).collect()] == [(1, False)]
    long = " ".join(f"w{i % 97}x{i % 89}" for i in range(9000))
    one_off = " ".join([*long.split()[:4000], *item.replace("12 km", "13 km").split()])
    numbered = spark.createDataFrame([(20, long), (21, one_off)], "doc_id long, text string")
    assert [r["doc_id"] for r in decontaminate.leaks(numbered, spark.createDataFrame([(1, long)], "item_id long, text string")).collect()] == [20]
    assert decontaminate.leaks(empty, b).count() == 0 and decontaminate.leaks(d, b.limit(0)).count() == 0


def test_preferences(spark):
    turns = [(1, 0, "user", "hi <|end|>"), (1, 1, "assistant", "yes"), (1, 2, "user", None), (2, 0, "user", "hm"), (2, 1, "assistant", "no"), (3, 0, "user", "alone"), (None, 0, "user", "x")]
    t = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r["chosen_id"]: r for r in preferences.preference_pairs(preferences.swapped_replies(t), ["chosen_id", "rejected_id"]).collect()}
    assert set(got) == {1, 2} and got[2]["rejected_id"] == 1
    r = got[1]
    assert r["common_turns"] == 1 and r["prompt"] == "<|user|>\nhi < |end|>\n".replace("|>\n", "|>\n", 1) + "<|end|>\n" or r["prompt"].startswith("<|user|>\nhi < |end|>")
    assert [r["chosen_completion"][s["begin"] : s["end"]] for s in r["chosen_spans"]] == ["yes"]
    assert [r["rejected_completion"][s["begin"] : s["end"]] for s in r["rejected_spans"]] == ["no"]
    assert preferences.swapped_replies(t.limit(0)).count() == 0


def test_preferences_of_equal_tied_and_long_conversations(spark):
    rng = random.Random(17)
    turns = [(1, i, rng.choice(["user", "assistant", "sys<|tem|>"]), f"turn {i} <|end|>", "x") for i in range(300)] + [(1, 300, "assistant", "last", "x")]
    turns += [(2, 0, "user", "q", "x"), (2, 1, "assistant", "same", "x"), (3, 0, "user", "q", "x"), (3, 1, "assistant", "same", "x"), (2, 1, "assistant", "same", "y")]
    t = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, chosen string")
    pairs = preferences.preference_pairs(preferences.swapped_replies(t), ["chosen_id", "rejected_id"]).collect()
    got = {r["chosen_id"]: r for r in pairs}
    assert set(got) == {1, 2, 3}
    own = sorted((i, r, x) for c, i, r, x, _ in turns if c == 1)
    whole = got[1]["prompt"] + got[1]["chosen_completion"]
    assert whole.count("<|end|>") == len(own)
    for side in ("chosen", "rejected"):
        for r in pairs:
            for s in r[f"{side}_spans"]:
                assert "<|" not in r[f"{side}_completion"][s["begin"] : s["end"]]
    # the next reply is the same one: nothing is preferred, and the spans are empty
    assert not got[2]["usable"] and got[2]["chosen_completion"] == "" and got[2]["chosen_spans"] == []
    assert [r["chosen_completion"][s["begin"] : s["end"]] for r in pairs if r["chosen_id"] == 1 for s in r["chosen_spans"]] == ["last"]
