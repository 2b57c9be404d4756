"""Brute force, round trips, held-out accuracy and odd inputs for each operator."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import pairwise

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from frameflow.llm import bpe, decontaminate, exact_dedup, jaccard_join, line_dedup, queries, secrets, suffix_tree_lm, token_files, toxicity, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in all columns, empty and long texts, ties, repeated rows, and columns with clashing names."""
    rows = [(1, "a b c d e f g", "x"), (2, "a b c d e f g", None), (2, "a b c d e f g", None), (3, None, "y"), (4, "", "z"), (None, "a b c d e f g", "n"), (None, None, None), (5, "long wörds " * 20_000, "l"), (6, "\t \n", "w")]
    names = "doc_id long, text string, id string"
    clash = ["key", "n", "score", "predicted", "keep_id", "ids", "_id", "_t", "part", "block", "lang", "source"]
    df = spark.createDataFrame(rows, names)
    return df.withColumns({c: F.lit(c) for c in clash})


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("1 = 0")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.word_bpe())


def test_secrets(spark, odd, empty):
    model = secrets.fit(secrets.made_up_findings(spark))
    held = secrets.with_features(secrets.made_up_findings(spark, 600, seed=99))
    from pyspark.ml.feature import VectorAssembler

    out = model.transform(VectorAssembler(inputCols=list(secrets.FEATURES), outputCol="features").transform(held))
    assert out.where("prediction = label").count() >= 0.95 * 600
    key = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    text = spark.createDataFrame([(1, f'so token = "{key}" it is'), (2, f"see commit {key} there"), (3, "call 4111111111111111 now"), (4, None)], DOCS)
    found = {r.doc_id: r for r in secrets.scan(text, model).collect()}
    assert found.keys() == {1, 2, 3} and [found[i].secret for i in (1, 2, 3)] == [True, False, False] and found[1].finding == key
    assert secrets.scan(odd, model).count() == secrets.scan(empty, model).count() == 0


def test_bpe_equals_library(library):
    rng = random.Random(4)
    texts = ["", "aaaaaaaa aaa aaaa", "İ ẞ ΑΣ é\x85z\xa0 don't I'LL 1234 ½ 日本語 \x00 \r\n\t", "<|endoftext|>a<|startoftext|> b", "''s '' 's"]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), 39, 97, 110, rng.randrange(0x300), rng.randrange(0xD800), 10, 32])) for _ in range(rng.randrange(60))) for _ in range(800)]
    ours, packed = bpe.loaded(queries.word_bpe()).encode_many(texts), token_files.library_encode(queries.word_bpe(), texts)
    for text, a, b in zip(texts, ours, packed, strict=True):
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(a, "<u4").tolist() == np.frombuffer(b, "<u4").tolist() == ids
        assert bpe.loaded(queries.word_bpe()).decode(a) == library.decode(ids, skip_special_tokens=False)


def test_bpe_rows(spark, odd, empty, library):
    ids = bpe.encode(odd, queries.word_bpe())
    assert ids.count() == odd.count() and bpe.encode(empty, queries.word_bpe()).count() == 0
    text = {r.doc_id: r.text for r in bpe.decode(ids, queries.word_bpe()).collect()}
    assert text[1] == "a</w> b</w> c</w> d</w> e</w> f</w> g</w>" and text[3] == text[4] == ""


def brute_components(docs, n, num, den):
    sets, root = {}, {}
    for i, t in docs:
        w = re.findall("[^\x20\x09-\x0d]+", lowered(t))
        m = min(n, len(w))
        sets[i], root[i] = {tuple(w[k : k + m]) for k in range(len(w) - m + 1)} if w else set(), i

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            common = len(sets[a] & sets[b])
            if common and den * common >= num * (len(sets[a]) + len(sets[b]) - common):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return sorted((i, len(sets[i]), find(i)) for i in ids)


@pytest.mark.parametrize("n, num, den, block", [(3, 90, 100, 500_000), (2, 70, 100, 500), (1, 80, 100, 500_000)])
def test_jaccard_join(spark, n, num, den, block):
    rng = random.Random(n)
    base = [[rng.choice("abcdefghijklmnop") * rng.randrange(1, 4) for _ in range(rng.choice([5, 12, 30, 80]))] for _ in range(6)]
    docs = []
    for i in range(150):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(5)):
            w[rng.randrange(len(w))] = rng.choice("xyz")
        docs.append((3 * i + 1, " ".join(w)))
    docs += [(7000, ""), (7001, None), (7002, "one"), (7003, "One")]
    found = jaccard_join.linked_components(spark.createDataFrame(docs, DOCS).repartition(5), n, num, den, block_shingles=block)
    assert sorted(map(tuple, found.collect())) == brute_components(docs, n, num, den)


@pytest.mark.parametrize(("num", "den"), [(80, 100), (90, 100)])
def test_jaccard_signatures_and_sketches_lose_no_pair(num, den):
    rng, plan, similar = np.random.default_rng(7), jaccard_join.PartEnum(num, den), 0
    for _ in range(1500):
        one = np.unique(rng.integers(0, 2**63, int(rng.integers(1, 600))).astype(np.uint64))
        less, more = (int(rng.integers(0, len(one) // 5 + 1)) for _ in range(2))
        two = np.unique(np.concatenate([rng.permutation(one)[less:], rng.integers(0, 2**63, more).astype(np.uint64)]))
        common = len(np.intersect1d(one, two))
        if den * common >= num * (len(one) + len(two) - common):
            similar += 1
            assert len(np.intersect1d(plan.signatures(one), plan.signatures(two)))
            assert jaccard_join.alike(np.array([len(one), len(two)]), [jaccard_join.sketch(one), jaccard_join.sketch(two)], num, den)
    assert similar > 100


def test_jaccard_sketches_tell_apart():
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 2**63, 400).astype(np.uint64)) for _ in range(30)]
    assert not jaccard_join.alike(np.array(list(map(len, sets))), list(map(jaccard_join.sketch, sets)), 80, 100)
    assert len(jaccard_join.alike(np.full(5, 400), [None, *map(jaccard_join.sketch, sets[:4])], 80, 100)) == 4


def test_jaccard_join_odd(odd, empty):
    found = {(r.doc_id, r.component_id) for r in jaccard_join.linked_components(odd).collect()}
    assert {(1, 1), (2, 1), (3, 3), (4, 4), (5, 5), (6, 6), (None, None)} == found
    assert jaccard_join.linked_components(empty).count() == 0


def brute_contamination(docs, items, window=13):
    words = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for i, t in items:
        w = words.findall(lowered(t))
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = []
    for i, t in docs:
        w = words.findall(lowered(t))
        hit, found = [False] * len(w), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if ids := windows.get(tuple(w[k : k + n])):
                    found |= ids
                    hit[k : k + n] = [True] * n
        out.append((i, len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), any(hit) and 20 * sum(hit) >= len(w)))
    return sorted(out)


@pytest.mark.parametrize("limit", [8_000_000, 0])
def test_decontaminate(spark, documents, limit):
    items = spark.read.parquet(f"{SF}/benchmark.parquet").unionByName(spark.createDataFrame([(900, "the of"), (901, "Idiot"), (902, None)], "item_id long, text string"))
    wanted = brute_contamination([(r.doc_id, r.text) for r in documents.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert sorted(map(tuple, decontaminate.contamination(documents, items, broadcast_bytes=limit).collect())) == wanted


def test_decontaminate_odd(spark, odd, empty):
    items = spark.createDataFrame([(None, "b c"), (1, None)], "item_id long, text string")
    assert decontaminate.contamination(odd, items).count() == odd.count() and decontaminate.contamination(empty, items).count() == 0
    assert decontaminate.contamination(odd, items.where("1 = 0")).where("contaminated").count() == 0


def test_line_dedup(spark):
    rng = random.Random(8)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.choice([6, 30, 120]))) for _ in range(25)]
    docs = []
    for i in range(40):
        lines = []
        for _ in range(6):
            line = list(rng.choice(base))
            if rng.random() < 0.5:
                line[rng.randrange(len(line))] = "z"
            lines.append("".join(line))
        docs.append((i, "\n".join([*lines, "", " "])))
    found = {(r.doc_id, r.line_no): (r.first_id, r.first_line_no) for r in line_dedup.line_components(spark.createDataFrame(docs, DOCS)).collect()}
    places = [(i, k, re.sub(r"\s+", " ", line).strip(" ")) for i, t in docs for k, line in enumerate(t.split("\n"))]
    distinct = list(dict.fromkeys(line for _, _, line in places if line))
    sets = [{x.lower()[k : k + 5] for k in range(max(1, len(x) - 4))} for x in distinct]
    root = list(range(len(distinct)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common >= 0.8 * (len(sets[a]) + len(sets[b]) - common):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    group = {line: find(k) for k, line in enumerate(distinct)}
    first = {}
    for i, k, line in places:
        if line:
            first.setdefault(group[line], (i, k))
    assert found.keys() == {(i, k) for i, k, _ in places}
    wrong = sum(found[i, k] != (first[group[line]] if line else (i, k)) for i, k, line in places)
    assert wrong <= 0.02 * len(places)


@pytest.mark.parametrize("block", [130, 100_000])
def test_line_dedup_compares_all_of_a_bucket(spark, block, monkeypatch):
    """One bucket of 40 lines of which pairs are alike, none of them with its first line: each pair is found."""
    rng = random.Random(3)
    lines = ["".join(rng.choice("abcdefgh") for _ in range(120)) for _ in range(20)]
    docs = list(enumerate([*lines, *(x[:60] + "z" + x[61:] for x in lines)]))
    write = line_dedup.written
    monkeypatch.setattr(line_dedup, "_buckets", lambda lines: write(lines.selectExpr("_l", "1L AS _b", "min(_l) OVER () AS _first", "count(_l) OVER () AS _size"), "one-bucket"))
    found = {r.doc_id: r.first_id for r in line_dedup.line_components(spark.createDataFrame(docs, DOCS), block_characters=block).collect()}
    assert found == {i: i % 20 for i in range(40)}


def test_line_dedup_recall_in_large_buckets(spark):
    """600 lines of three templates, 100 characters of each the same: of the pairs that are similar, those put in one component."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("aeinorstlmduc") for _ in range(rng.randrange(3, 9)))
    heads = [" ".join(word() for _ in range(16))[:100] for _ in range(3)]
    docs = [(i, heads[i % 3] + " " + " ".join(word() for _ in range(rng.choice([1, 2, 4, 8])))) for i in range(600)]
    sets = [{t[k : k + 5] for k in range(len(t) - 4)} for _, t in docs]
    root = {r.doc_id: r.first_id for r in line_dedup.line_components(spark.createDataFrame(docs, DOCS)).collect()}
    pairs = [(a, b) for a in range(600) for b in range(a % 3, a, 3) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    joined = sum(root[a] == root[b] for a, b in pairs)
    print("similar pairs", len(pairs), "joined", joined)
    assert len(pairs) > 1000 and joined >= 0.999 * len(pairs)


@pytest.mark.parametrize(("least", "how"), [(49, {}), (30, {"n": 3})])
def test_line_dedup_finds_one_changed_character(spark, least, how):
    rng = random.Random(4)
    lines = ["".join(rng.choice("abcdefghijklmnop") for _ in range(k)) for k in range(least, 101)]
    docs = [(k, "\n".join(lines[k] if i == 0 else lines[k][: len(lines[k]) // 2] + "z" + lines[k][len(lines[k]) // 2 + 1 :] for i in range(2))) for k in range(len(lines))]
    found = line_dedup.line_components(spark.createDataFrame(docs, DOCS), **how).where("kept AND line_no = 1").count()
    assert found <= 0.02 * len(lines)


def test_line_dedup_keeps_lines_of_short_stretches(spark):
    """Lines in which one letter comes every few characters, and lines that repeat themselves: none is left out, and equal sets are one line."""
    here = "here we see them once there; " * 6
    docs = [(1, here), (2, here[:-3] + "x"), (3, "abc e " * 30), (4, "abcdefgh" * 4), (5, "abcdefgh" * 40), (6, "qrstuvwx"), (7, "qrstuvwxy")]
    found = {r.doc_id: r.first_id for r in line_dedup.line_components(spark.createDataFrame(docs, DOCS)).collect()}
    assert found == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 6, 7: 6}


def test_line_dedup_finds_scattered_edits(spark):
    """Pairs just above the threshold by single changed characters, far from each other: all are found, whatever their lengths."""
    rng = random.Random(12)
    docs, sets = [], lambda t: {t[k : k + 5] for k in range(len(t) - 4)}
    for i in range(300):
        line = "".join(rng.choice("aeinorst eld") for _ in range(rng.choice([60, 90, 130, 200, 400]))).strip().replace("  ", " a")
        near, places = line, list(range(8, len(line) - 8, 12))
        rng.shuffle(places)
        for k in places:
            more = near[:k] + "z" + near[k + 1 :]
            if 5 * len(sets(line) & sets(more)) < 4 * len(sets(line) | sets(more)):
                break
            near = more
        docs += [(2 * i, line), (2 * i + 1, near)]
    found = {r.doc_id: r.first_id for r in line_dedup.line_components(spark.createDataFrame(docs, DOCS)).collect()}
    assert [i for i in range(300) if found[2 * i] != found[2 * i + 1]] == []


def test_line_dedup_verifies_the_closest_first(spark, monkeypatch):
    """Of 30 lines that are all alike each is verified once: pairs whose parts are joined by then build no sets."""
    rng = random.Random(13)
    base, pairs, verify = "".join(rng.choice("abcdefghijklmnop") for _ in range(300)), [], line_dedup._verified
    docs = [(i, base[: 9 * i + 9] + "z" + base[9 * i + 10 :]) for i in range(30)]
    monkeypatch.setattr(line_dedup, "_verified", lambda found, *rest: pairs.append(found.count()) or verify(found, *rest))
    found = {r.doc_id: r.first_id for r in line_dedup.line_components(spark.createDataFrame(docs, DOCS)).collect()}
    assert found == dict.fromkeys(range(30), 0) and sum(pairs) == 29


def test_line_dedup_sketches_leave_few_pairs(spark):
    """Long lines that are nearly similar, and ones that repeat a few runs, are told apart by their sketches; no similar pair is."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    base, lines = [word() for _ in range(120)], []
    for changed in [*[2] * 20, *[16] * 20]:
        at = set(rng.sample(range(120), changed))
        lines.append(" ".join(word() if i in at else w for i, w in enumerate(base)))
    lines += [f"{word()} " * 120 for _ in range(20)]
    texts = spark.createDataFrame(list(enumerate(lines)), "_l long, _line string")
    sketched, share = line_dedup._sketched(texts, 5), line_dedup.Fraction(4, 5)
    x, y = (sketched.select(F.col("_l").alias(k), F.col("_sk").alias(f"{k}s")) for k in "ab")
    close = x.join(y, F.col("a") < F.col("b")).where(line_dedup.may_be_similar(F.col("as"), F.col("bs"), share))
    sets = [{v[i : i + 5] for i in range(len(v) - 4)} for v in lines]
    alike = {(i, j) for j in range(60) for i in range(j) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    found = {(r.a, r.b) for r in close.collect()}
    assert alike and alike <= found and len(found - alike) < 20
    assert {r._l: r._sk.n for r in sketched.collect()}[45] < 10


def test_line_dedup_odd(odd, empty):
    assert line_dedup.line_components(odd).count() == odd.count() + 1 and line_dedup.line_components(empty).count() == 0


@pytest.mark.parametrize("bits", [1, 7, 13, 16, 17, 32])
def test_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 10_001).astype(np.uint32)
    f = token_files.TokenFile(token_files.file_bytes(np.array([5, 9]), np.array([1, 10_000]), ids, bits))
    assert (f.document(0) == ids[:1]).all() and (f.document(1) == ids[1:]).all() and (f.ids(4090, 4100) == ids[4090:4100]).all()


def test_token_files(spark, documents, library):
    folder, _ = token_files.write(documents, queries.word_bpe(), end_id=1)
    found, start = {r.doc_id: r for r in token_files.digests(spark, folder).collect()}, 0
    for r in sorted(documents.collect(), key=lambda r: r.doc_id):
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 1]
        assert tuple(found[r.doc_id]) == (r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_library_encode_splits_plain_texts_once(monkeypatch):
    known = token_files.LibraryEncoder(queries.word_bpe())
    monkeypatch.setitem(token_files._LIBRARY, queries.word_bpe(), known)
    split, seen = known.split, []
    known.split = lambda chunk: seen.append(chunk) or split(chunk)
    texts = ["Don't split 12 of these, über-alles!! 's", "", "\u4e2d\u6587 don't"]
    found = token_files.library_encode(queries.word_bpe(), texts)
    assert sorted(seen) == ["don't", "\u4e2d\u6587"]
    assert found == [np.array(known.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_token_files_odd(spark, odd):
    folder, _ = token_files.write(odd, queries.word_bpe(), end_id=1)
    rows = token_files.read(spark, folder).collect()
    assert len(rows) == odd.count() and [r.ids for r in rows if r.doc_id == 3] == [[1]] and min(rows, key=lambda r: r.start).doc_id is None


def test_toxicity(spark, odd, empty):
    rng = random.Random(1)
    plain = ["house", "river", "stone", "light", "winter", "garden", "window", "summer", "silver", "music"]
    docs, labels = [], []
    for i in range(600):
        words = [rng.choice(plain) for _ in range(40)]
        toxic = i % 5 == 0
        for _ in range(4 if toxic else 0):
            words[rng.randrange(40)] = "grobian" + rng.choice(["en", "s", "haft", "um"]) if i % 2 else rng.choice(["worthless", "disgustng"])
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    d, y = spark.createDataFrame(docs, DOCS), spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(d, y)
    assert any(s.startswith("grobian") for s in model.lexicon.stems)
    out = toxicity.score(d, model).where(toxicity.held_out()).join(y.where("toxic IS NOT NULL"), "doc_id")
    assert out.where("predicted <> toxic").count() <= 0.03 * out.count()
    assert model.lexicon.distance("Disgustin,") == 1 and model.lexicon.distance("disgusting") == 0 and model.lexicon.distance("window") is None
    quoted, bare = (model.lexicon.features(t) for t in ('they wrote "a worthless thing" once', "they are a worthless thing once"))
    assert quoted[0] == bare[2] == 0 and quoted[2] == bare[0] > 0
    assert toxicity.score(odd, model).count() == odd.count() and toxicity.score(empty, model).count() == 0
    assert toxicity.score(odd, toxicity.fit(empty, y.where("1 = 0"))).where("predicted = 1").count() == 0


def test_warc(spark):
    schema = "page_id long, url string, html string"
    rows = [(1, "http://a", "same"), (2, "http://b\n c", "same"), (3, None, None), (4, "u", ""), (5, "u", "ü\r\n\r\nWARC/1.1"), (None, "n", "same"), (6, "l", "long" * 500_000)]
    folder, index = warc.write(spark.createDataFrame(rows, schema))
    found = {r.page_id: r for r in warc.read(spark, folder).collect()}
    for i, to in ((1, 2), (2, None), (3, 4), (4, None), (5, None), (None, 2), (6, None)):
        payload = next(h for p, _, h in rows if p == i) or ""
        digest = base64.b32encode(hashlib.sha1(payload.encode()).digest()).decode()
        assert tuple(found[i])[1:] == (len(payload.encode()), digest, "revisit" if to else "response", to)
    for r in index.where("page_id IS NOT NULL").collect():
        head, _, end = warc.parse(warc.fetch(folder, r.bundle, r.frame, r.offset, r.length))
        assert head["WARC-Record-ID"] == f"<urn:page:{r.page_id}>" and end == r.length
    assert warc.write(spark.createDataFrame([], schema))[1].count() == 0


def test_exact_dedup(spark, odd, empty):
    found = {r.doc_id: r for r in exact_dedup.duplicate_groups(odd, keep="max").collect()}
    assert (found[1].keep_id, found[1].group_size, found[1].kept) == (2, 4, False) and found[2].kept and found[3].keep_id == 4
    assert exact_dedup.duplicate_groups(empty).count() == 0
    weak = exact_dedup.duplicate_groups(odd, keep="max", hashed=lambda t: F.octet_length(t) % 2)  # nearly all texts collide
    assert sorted(map(repr, weak.collect())) == sorted(map(repr, exact_dedup.duplicate_groups(odd, keep="max").collect()))
    kept = exact_dedup.unique_rows(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 5, 6] and exact_dedup.unique_rows(empty).count() == 0


def test_language_model(spark, documents, odd, empty):
    found = {r.doc_id: r for r in suffix_tree_lm.score(documents, block_tokens=20_000).collect()}
    words = {r.doc_id: [*re.findall("[^\x20\x09-\x0d]+", lowered(r.text)), None] for r in documents.collect()}
    trained = {i for i in words if zlib.crc32(str(i).encode()) % 7 != 2}
    c = Counter(w for i in trained for w in words[i])
    n, v = sum(c.values()), len(c)
    for i, w in words.items():
        r = found[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(x in c for x in w), n, i not in trained)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w))
    assert sum(r.score for r in found.values() if r.held_out) > sum(r.base_score for r in found.values() if r.held_out)
    assert suffix_tree_lm.score(odd).count() == odd.count() and suffix_tree_lm.score(empty).count() == 0


def test_language_model_depends_on_context(spark):
    """After a a comes b, after b b comes a: a tree of two words is sure of itself, and its probabilities sum to 1."""
    text = " ".join(["a", "a", "b", "b"] * 500)
    docs = spark.createDataFrame([(i, text) for i in range(8)], DOCS)
    r = suffix_tree_lm.score(docs, held=F.col("id") == 7).where("held_out").first()
    assert r.score > 0.2 * r.base_score
    # What may follow "a b" as the last words: each known word, an unknown one, or the end. Texts differ in the last two tokens alone.
    ends = ["a b a", "a b b", "a b zzz", "a b"]
    tails = spark.createDataFrame([*[(i, text) for i in range(8)], *[(10 + k, t) for k, t in enumerate(ends)], (20, "a b a x"), (21, "a b b x"), (22, "a b zzz x")], DOCS)
    got = {x.doc_id: x.score for x in suffix_tree_lm.score(tails, held=F.col("id") > 7).where("held_out").collect()}
    expected = tree_scores([(r.doc_id, r.text) for r in tails.collect()], set(range(10, 23)), suffix_tree_lm.LEAST, 3)
    assert got == pytest.approx({i: expected[i] for i in got})
    assert tree_next(["a", "b"], [(i, text) for i in range(8)], 10, 3) == pytest.approx(1)


def tree_next(context, docs, least, depth):
    """The sum of the probabilities of all that may follow: each known word, the end, and unknown words together."""
    words = {w for _, t in docs for w in t.split()}
    ask = lambda tail: tree_scores([*docs, (-1, " ".join([*context, *tail]))], {-1}, least, depth)[-1]
    before = tree_scores([*docs, (-1, " ".join(context))], {-1}, least, depth)
    parts = tree_scores([*docs, (-1, " ".join(context))], {-1}, least, depth, each=True)[-1]
    assert sum(map(math.log10, parts)) == pytest.approx(before[-1]) and ask(["a"]) < 0
    return parts[-1] + sum(tree_scores([*docs, (-1, " ".join([*context, w]))], {-1}, least, depth, each=True)[-1][len(context)] for w in [*words, "unknown word".replace(" ", "")])


def tree_scores(docs, held, least, depth, divergence=0.02, discount=0.75, each=False):
    """Scores by dictionaries, from the definition; with each, the probabilities of the tokens."""
    texts = {i: [*t.split(), None] for i, t in docs}
    trained = [w for i, w in texts.items() if i not in held]
    words = Counter(x for w in trained for x in w)
    n, v = sum(words.values()), len(words)
    base = lambda x: (words[x] + 1) / (n + v + 1)
    symbol = lambda x: x if words[x] >= least else "<other>"
    rest = 1 - sum(base(x) for x in words if words[x] >= least)
    root = lambda a: rest if a == "<other>" else base(a)
    moves = {}
    for w in trained:
        for t in range(len(w)):
            for d in range(1, min(t, depth) + 1):
                moves.setdefault(tuple(w[t - d : t]), Counter())[symbol(w[t])] += 1
    moves = {s: c for s, c in moves.items() if c.total() >= least}
    kept = set()
    for s, c in moves.items():
        up = moves.get(s[1:])
        if sum(k / c.total() * math.log(k / c.total() / (up[a] / up.total() if up else root(a))) for a, k in c.items()) >= divergence:
            kept |= {s[k:] for k in range(len(s))}

    def p(s, a):
        if not s:
            return root(a)
        if s not in kept:
            return p(s[1:], a)
        c = moves[s]
        return (max(c[a] - discount, 0) + discount * len(c) * p(s[1:], a)) / c.total()

    probabilities = {i: [p(tuple(w[max(0, t - depth) : t]), symbol(w[t])) * (1 if symbol(w[t]) == w[t] else base(w[t]) / rest) for t in range(len(w))] for i, w in texts.items()}
    return probabilities if each else {i: sum(map(math.log10, x)) for i, x in probabilities.items()}


@pytest.mark.parametrize(("block", "ranged", "least", "depth"), [(300, 100, 10, 2), (100_000, 500_000, 10, 3), (300, 40, 3, 3), (1000, 150, 2, 4), (300, 100, 1, 1)])
def test_language_model_equals_dictionaries(spark, block, ranged, least, depth):
    """Also where ranges are far smaller than contexts, so that most contexts of one word are cut."""
    rng = random.Random(5)
    docs = [(i, " ".join(f"w{min(int(rng.paretovariate(0.7)), 300) + (k % 3) * (rng.random() < 0.5)}" for k in range(rng.randrange(80)))) for i in range(120)]
    docs += [(i, "the same long line again and again") for i in range(200, 260)]
    for divergence in (0.02, 0.6):
        expected = tree_scores(docs, set(range(100, 120)), least, depth, divergence)
        found = suffix_tree_lm.score(spark.createDataFrame(docs, DOCS), held=F.col("doc_id").between(100, 119), block_tokens=block, range_tokens=ranged, least=least, depth=depth, divergence=divergence).collect()
        assert {r.doc_id: r.score for r in found} == pytest.approx(expected)


def test_language_model_keeps_contexts_of_small_share(spark):
    """A phrase that occurs 30 times among 400,000 tokens (a share of 7.5e-5) is in the tree."""
    rng = random.Random(6)
    docs = [(i, " ".join(rng.choice("abcdefgh") for _ in range(4000)) + (" one two three" if i < 30 else "")) for i in range(100)]
    r = suffix_tree_lm.score(spark.createDataFrame([*docs, (100, "one two three")], DOCS), held=F.col("doc_id") == 100).where("held_out").first()
    assert r.score > 0.5 * r.base_score


def test_pipeline(spark, documents):
    docs, sizes = documents, []
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.written(stage(spark, docs, SF), name.replace(" ", "-"))
        sizes.append((docs.count(), after.count()))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == docs.columns
        docs = after
    assert all(a >= b for a, b in sizes) and all(a[1] == b[0] for a, b in pairwise(sizes)) and sizes[-1][0] == sizes[-1][1]


def test_pipeline_odd(spark, odd, empty):
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, odd, SF).collect()
        assert stage(spark, empty, SF).count() == 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries(spark, name):
    from test_queries import against_sql

    if name in queries.SQL:
        against_sql(spark, queries.QUERIES[name], queries.SQL[name])
    else:
        assert queries.QUERIES[name](spark, SF).count() > 0


def test_near_copies_are_judged_by_row(spark):
    """Rows that share a doc_id are told apart by their texts, and components that share a smallest id by their members."""
    a, b = (" ".join(f"{x}{k}" for k in range(60)) for x in "ab")
    docs = spark.createDataFrame([(1, a), (7, a + " z"), (7, b), (8, b + " z"), (9, None), (None, a)], DOCS)
    kept = corpus_pipeline.drop_near_copies(spark, docs, SF).collect()
    assert sorted(map(tuple, kept), key=repr) == sorted([(1, a), (7, b), (9, None), (None, a)], key=repr)


def test_toxicity_of_equal_texts_with_different_labels(spark):
    docs = spark.createDataFrame([(i, f"plain text {i % 3}") for i in range(1, 40)], DOCS)
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(1, 40)], "doc_id long, toxic int")
    scores = {tuple(r.score for r in toxicity.score(docs.repartition(n), toxicity.fit(docs.repartition(n), labels)).orderBy("doc_id").collect()) for n in (1, 7)}
    assert len(scores) == 1


def test_digests(spark, odd, library):
    found = sorted(map(tuple, bpe.digests(odd, queries.word_bpe()).collect()), key=repr)
    wanted = []
    for r in odd.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        wanted.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert found == sorted(wanted, key=repr)


def test_toxicity_lexicon_edits():
    found = toxicity.Lexicon(["scum"], ["idiot", "stupid"]).distance
    assert found("scum") == found("idiotic") == found("stupidly") == 0
    assert found("stupdi") == found("stupdily") == found("stuipd") == found("stpid") == 1  # a swap, and a letter left out
    assert found("id1ot") == found("idoit") == found("scvm") == found("sucm") == 2
    assert found("id1otic") is None and found("summer") is None and found("stpdi") is None


def test_toxicity_lexicon_counts_near_copies_once(spark):
    """A rare word of one text in many near copies is not learned; the word that marks many different texts is."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abdeiklmnorstu") for _ in range(6))
    text = [word() for _ in range(80)]
    docs = [(i, " ".join([*text[:40], "rarissima", *text[40:], word(), "grobian"])) for i in range(100)]
    docs += [(i, " ".join([*(word() for _ in range(60)), *(["grobian"] if i % 2 else [])])) for i in range(100, 400)]
    model = toxicity.fit(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(i, int(i < 100 or i % 2)) for i in range(400)], "doc_id long, toxic int"))
    assert any("grobian".startswith(s) for s in model.lexicon.stems)
    assert not any("rarissima".startswith(s) for s in model.lexicon.stems)
