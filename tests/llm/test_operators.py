import base64
import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import brute
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pitline.llm import bpe, chat, licenses, mixing, pii, quality, queries, simhash, token_counts, topk, warc

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "abcdef" * 20_000
EDGE = [
    (1, "Contact ann@example.com or +1 (415) 555-2671 today, says Anna. " * 3, "en", "a"),
    (1, "Contact ann@example.com or +1 (415) 555-2671 today, says Anna. " * 3, "en", "a"),  # a repeated row
    (2, None, "en", "a"),
    (3, "", None, None),
    (None, "all rights reserved <|endoftext|> 10.0.0.1", "en", "a"),
    (None, None, None, None),
    (4, LONG, "fr", ""),
    (5, "one " * 5_000, "de", "b"),
    (6, " \t\n\x0b ", "de", "b"),
    (7, "Größe ½ ² 漢字 \U0001f600 é K " + "퟿", "de", "b"),
    (8, "1234567890" * 3_000, "en", "a"),
    (-9, "a.b@c@d-e.f-g@x.y +123 4111 1111 1111 1111 999.1.1.1 001.002.003.255 ...@a.b", "en", "a"),
]
CLASHES = ("row", "ids", "fingerprint", "component_id", "kept", "n", "g", "key", "copy", "at", "id", "t", "low", "base", "llm_in", "llm_text", "n_words")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.collect()}


@pytest.fixture(scope="module")
def edge(spark):
    rows = [(*r, len(r[1] or "")) for r in EDGE]
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(i) for i, c in enumerate(CLASHES)})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def same(found, wanted):
    order = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(tuple, found), key=order) == sorted(wanted, key=order)


# byte-level BPE


@pytest.fixture(scope="module")
def vocabulary(spark):
    return queries.vocabulary(spark)


@pytest.fixture(scope="module")
def reference():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encode_equals_library_and_decodes(spark, edge, documents, vocabulary, reference):
    for docs in (edge, documents):
        encoded = bpe.encode(docs, vocabulary)
        back = bpe.decode(encoded.select(F.col("row.text").alias("text"), "ids", "n_tokens"), vocabulary, ["text", "ids", "n_tokens"]).collect()
        assert len(back) == docs.count()
        for r in back:
            want = reference.encode_ordinary(r["text"] or "")
            assert np.frombuffer(r["ids"], "<u4").tolist() == want and r["n_tokens"] == len(want)
            assert bytes(r["decoded"]) == (r["text"] or "").encode()


def test_query_digests(spark, texts, reference):
    for r in queries.op3_byte_bpe(spark, SF).collect():
        ids = reference.encode_ordinary(texts[r["doc_id"]] or "")
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == brute.sha(np.array(ids, "<u4").tobytes()) and r["decoded_sha256"] == brute.sha(texts[r["doc_id"]] or "")


def test_odd_ranks_and_blocks(monkeypatch):
    """Ranks of no training run: merged tokens may rank below their parts. Texts longer than a block, and a cache that is too small."""
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 40)
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 30)
    rng = random.Random(3)
    for _ in range(5):
        ranks = {bytes([b]): b for b in range(256)}
        for t in sorted({"".join(rng.choices("abc", k=rng.randrange(2, 6))) for _ in range(90)}, key=lambda _: rng.random()):
            ranks[t.encode()] = len(ranks)
        library = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        texts = ["".join(rng.choices("abc ", [9, 9, 9, 1], k=rng.randrange(120))) for _ in range(200)]
        assert [np.frombuffer(x, "<u4").tolist() for x in bpe.Encoder(ranks, public_tokenizers.PATTERN).encode(texts)] == [library.encode_ordinary(t) for t in texts]


def test_recurring_pre_tokens_are_merged_once(monkeypatch):
    """A full cache does not forget what every block has; few long pre-tokens fill it as many short ones do."""
    encoder = bpe.Encoder({bytes([b]): b for b in range(256)}, public_tokenizers.PATTERN)
    merged, merge = [], encoder.merge
    monkeypatch.setattr(encoder, "merge", lambda pieces: merged.extend(pieces) or merge(pieces))
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 10)
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 20)
    texts = [f"often{chr(97 + i // 20) * 3} seldom{chr(97 + i % 20) * 2}" for i in range(60)]
    assert [x[::4] for x in encoder.encode(texts)] == [t.encode() for t in texts]
    assert sorted(p for p in merged if p.startswith(b"often")) == [b"oftenaaa", b"oftenbbb", b"oftenccc"]
    monkeypatch.setattr(bpe, "CACHE_CHARS", 500)
    encoder.encode([chr(97 + i) * 400 for i in range(5)])
    assert max(sum(map(len, c)) for c in (encoder.cache, encoder.old)) <= 500


def test_lists(edge, vocabulary, reference):
    for r in bpe.encode(edge, vocabulary, packed=False).collect():
        assert r["ids"] == reference.encode_ordinary(r["row"]["text"] or "") and r["n_tokens"] == len(r["ids"])


# token counts


def test_counts_equal_library(spark, edge, documents):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    for docs in (edge, documents):
        found = token_counts.count_tokens(docs, token_counts.CountTable(spark, path, docs)).select("row.text", "n_tokens", "n_bytes").collect()
        for r in found:
            assert r["n_tokens"] == len(library.encode(r["text"] or "", add_special_tokens=False).ids)
            assert r["n_bytes"] == len((r["text"] or "").encode())


def test_stable_ranges_split_alike():
    """Within STABLE the pattern splits as the library does; texts beyond it are split by the library."""
    counts = token_counts.Counts(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read())
    split = counts.tokenizer.pre_tokenizer.pre_tokenize_str
    inside = re.compile(f"[{token_counts.STABLE}]").fullmatch
    for c in filter(inside, map(chr, range(0x10000))):
        s = f"a{c}1{c}!{c}  {c} b"
        assert counts.pieces(s) == [s[a:b] for _, (a, b) in split(s)], hex(ord(c))


# SimHash


def test_fingerprint():
    rng = random.Random(1)
    for _ in range(60):
        text = "".join(rng.choices("abAÉ \t\n\x0b\x85", k=rng.randrange(80)))
        assert simhash.fingerprint(text) % (1 << 64) == brute.fingerprint(text)


def test_groups_equal_brute_force(spark, edge, texts):
    r = queries.op8_simhash_groups(spark, SF).collect()
    prints = [(d, brute.fingerprint(t)) for d, t in texts.items()]
    same(r, [(d, f"{p:016x}", c) for (d, p), c in zip(prints, brute.components(prints), strict=True)])
    prints = [(d, brute.fingerprint(t)) for d, t, *_ in EDGE]
    found = simhash.near_duplicate_groups(edge).collect()
    same([(a, b % (1 << 64), c) for a, b, c in found], [(d, p, c) for (d, p), c in zip(prints, brute.components(prints), strict=True)])


def test_links_of_planted_fingerprints(spark):
    """Chains, stars and whole balls of fingerprints; every pair within two bits is connected, nothing else is."""
    rng = random.Random(5)
    prints = []
    for _ in range(12):
        f = rng.getrandbits(64)
        for _ in range(30):
            prints.append(f)
            f ^= sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 4)))
    center = rng.getrandbits(64)
    prints += [center ^ 1 << b for b in range(64)]
    rows = [(i, p) for i, p in enumerate(prints)]
    signed = spark.createDataFrame([(p - (p >> 63 << 64),) for p in prints], "fingerprint long")
    roots = {r["node"] % (1 << 64): r["root"] for r in simhash.components(simhash.linked_fingerprints(signed)).collect()}
    groups = [roots.get(p, p) for p in prints]
    first = {}
    assert [first.setdefault(g, i) for i, g in enumerate(groups)] == brute.components(rows)


def test_keep_one(edge, documents):
    for docs, least in ((documents, 1), (edge, 1)):
        kept = simhash.keep_one(docs)
        assert kept.columns == docs.columns
        groups = defaultdict(list)
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        prints = [(i, brute.fingerprint(t, 5)) for i, (_, t) in enumerate(rows)]
        for i, c in enumerate(brute.components(prints)):
            groups[c].append(rows[i])
        found = [(r["doc_id"], r["text"]) for r in kept.collect()]
        assert len(found) == len(groups)
        assert sorted(str(x[0]) for x in found) == sorted(str(min((d for d, _ in g if d is not None), default=None)) for g in groups.values())


# quality


def test_counts(spark, edge):
    for d, t, *_ in EDGE:
        assert quality.text_counts(t) == brute.counts(t[:20_000] if t and len(t) > 20_000 and " " not in t else t) or len(t) > 20_000
    rng = random.Random(2)
    for _ in range(300):
        t = "".join(rng.choices(["a ", "b ", "c\n", "#", "  ", "\x0b", "\n"], [9, 9, 3, 1, 1, 1, 2], k=rng.randrange(120)))
        assert quality.text_counts(t) == brute.counts(t)


def test_quality_query(spark, texts):
    for r in queries.op5_quality_rules(spark, SF).collect():
        want = brute.counts(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        failed = want[0] < 20 or 100 * want[4] > 30 * want[0]
        assert r["base_failed"] == failed and not (failed and r["kept"])


def test_mcd_finds_outliers_that_move_mean_and_covariance(spark, monkeypatch):
    """A fifth of the vectors lies far off; the estimate is that of the others, and only those are rejected."""
    rng = np.random.default_rng(0)
    good = rng.normal([5, 1.5, 0.2, 0.2, 0.2], [0.5, 0.1, 0.1, 0.1, 0.1], (4_000, 5))
    bad = rng.normal([8, 3.0, 3.0, 0.2, 0.2], 0.1, (1_000, 5))
    rows = spark.createDataFrame([("g", x.tolist()) for x in np.vstack([good, bad])], "g string, x array<double>")
    est = quality.estimates(rows, ["g"])
    r = est.first()
    precision = np.array(r["precision"]).reshape(5, 5)
    d = lambda m: np.einsum("ij,jk,ik->i", m - np.array(r["center"]), precision, m - np.array(r["center"]))
    assert np.abs(np.array(r["center"]) - good.mean(axis=0)).max() < 0.1
    assert (d(good) > quality.CUT).mean() == 0 and (d(bad) > quality.CUT).all()
    assert abs(quality.consistency(1 - 1e-9) - 1) < 1e-3


def test_quality_edges(edge, empty):
    found = quality.assess(edge).collect()
    assert len(found) == len(EDGE) and not any(r["kept"] for r in found if r["base_failed"])
    assert quality.keep_good(edge).columns == edge.columns
    assert quality.assess(empty).count() == 0


# personal data


def test_base_spans():
    rng = random.Random(4)
    for t in [t for _, t, *_ in EDGE if t and len(t) < 5_000] + ["".join(rng.choices("a.@-+ 1294()%", k=rng.randrange(60))) for _ in range(4_000)]:
        assert pii.base_spans(t) == brute.personal(t), t


def test_long_runs_are_linear():
    for t in ("a" * 300_000, "1" * 300_000, "a@" * 100_000, "1." * 100_000, "+1" * 100_000, "1 " * 100_000, "+1" + "." * 300_000):
        pii.base_spans(t)


def test_pii_query(spark, texts):
    for r in queries.op4_private_data(spark, SF).collect():
        base = brute.personal(texts[r["doc_id"]])
        assert r["base_sha256"] == brute.sha(",".join(f"{k}:{a}:{b}" for k, a, b in base))
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == k for x in base) for k in pii.KINDS]
        assert r["spans"].startswith(",".join(f"{k}:{a}:{b}" for k, a, b in base))


def test_disclosing_terms(spark):
    """A name that stands only by one address is found in its contexts, common words are not, and clean documents stay as they are."""
    rows = [(i, f"the quick words of text number n{i} go on and on", None) for i in range(60)]
    rows += [(100 + i, f"the words of Kowalski at kow@example.com go on {'and on ' * i}", None) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r["doc_id"]: r for r in pii.find_spans(docs).collect()}
    assert all(not r["terms"] and not r["base"] for d, r in found.items() if d < 100)
    for i in range(4):
        text = rows[60 + i][1]
        assert [text[s["start"] : s["end"]] for s in found[100 + i]["terms"]] == ["Kowalski"]
    # by hand: 64 documents, 4 with the entity, 4 with the name, 4 with both
    narrow = pii.with_base(docs.withColumnRenamed("text", "t"), ["doc_id"], "t")
    pairs = {r["term"]: r["ratio"] for r in pii.disclosing_pairs(docs, narrow, "text").collect()}
    assert math.isclose(pairs["kowalski"], 1.0) and math.isclose(pairs["words"], 0.0, abs_tol=1e-9)
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert clean[100] == "the words of  at [EMAIL] go on " and all(clean[d] == t for d, t, _ in rows[:60])


def test_pii_edges(edge, empty):
    found = pii.find_spans(edge).collect()
    same([(r["doc_id"], len(r["base"])) for r in found], [(d, len(brute.personal(t))) for d, t, *_ in EDGE])
    clean = pii.sanitise(edge)
    assert clean.columns == edge.columns and clean.count() == len(EDGE)
    assert pii.find_spans(empty).count() == 0 and pii.sanitise(empty).count() == 0


# mixing


def test_mixing_counts(spark):
    rows = [(i, f"t{i}", "en", ["big", "mid", "none", None][(i % 10 > 5) + (i % 10 > 7) + (i % 10 > 8)], 0) for i in range(4_000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    weights = spark.createDataFrame([("big", 1.0), ("mid", 3.0), (None, 6.0)], "s string, w double")
    out = mixing.mix(docs, weights, rows=40_000).select("row.source", "row.doc_id", "copy").collect()
    n = Counter(r["source"] for r in out)
    assert set(n) == {"big", "mid", None}
    for s, share in (("big", 0.1), ("mid", 0.3), (None, 0.6)):
        assert abs(n[s] - share * 40_000) < 5 * math.sqrt(share * 40_000)
    times = Counter(r["doc_id"] for r in out if r["source"] == "big")
    mean = 0.1 * 40_000 / 2_400
    for k in range(5):
        p = math.exp(-mean) * mean**k / math.factorial(k)
        seen = sum(times.get(i, 0) == k for i, *_ , s, _ in rows if s == "big")
        assert abs(seen - p * 2_400) < 5 * math.sqrt(p * 2_400) + 1
    assert all(set(g) == set(range(1, len(g) + 1)) for g in ([r["copy"] for r in out if r["doc_id"] == d] for d in list(times)[:20]))
    order = [r["doc_id"] for r in out if r["copy"] == 1]
    assert order != sorted(order) and mixing.mix(docs, weights, rows=40_000).count() == len(out)


def test_mixing_edges(edge, empty):
    out = mixing.mix(edge, rows=2_000)
    assert out.select("row.*").columns == edge.columns
    twice = [r["n"] for r in out.where("row.doc_id = 1").groupBy("copy").agg(F.count("*").alias("n")).collect()]
    assert set(twice) <= {2}  # repeated rows are drawn alike
    assert mixing.mix(empty).count() == 0


def test_salted_join_gives_the_same(edge, monkeypatch):
    many = mixing.mix(edge, rows=500).select("row.doc_id", "copy").collect()
    monkeypatch.setattr(mixing, "at_most", lambda df: False)
    same(mixing.mix(edge, rows=500).select("row.doc_id", "copy").collect(), list(map(tuple, many)))


# licenses


def test_license_scan(spark, edge, documents, empty):
    for docs in (edge, documents):
        for threshold in (0.85, 0.5):
            found = licenses.scan(docs, threshold=threshold).collect()
            assert len(found) == docs.count()
            for r in found:
                want = brute.license_scan(r["row"]["text"], licenses.PHRASES, licenses.TEMPLATES, threshold)
                assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], r["score"]) == want
    assert licenses.scan(empty).count() == 0 and licenses.scan(edge, templates={}).count() == len(EDGE)


def test_wrapped_notices_and_many_templates(spark):
    """Notices wrapped as comments match as whole ones do; a vocabulary of any size is compared exactly."""
    def wrapped(text, mark):
        lines, line = [], mark
        for w in text.split():
            if len(line) + len(w) > 60:
                lines, line = [*lines, line, ""], mark
            line += " " + w
        return "\n".join(["some words before", *lines, line, "and some after"])

    texts = [wrapped(t, mark) for t in licenses.TEMPLATES.values() for mark in ("#", " *", "//")]
    texts += ["\n".join(licenses.TEMPLATES["mit"].split()), "x\n\nReleased under\nthe MIT\n\nLicense.\ny"]
    rng = random.Random(8)
    many = {f"t{i}": " ".join(f"w{rng.randrange(9_000)}" for _ in range(30)) for i in range(400)}
    texts += [many["t7"].replace(" ", "\n", 1), many["t8"] + " more", "\n".join(many["t9"].split()[:20])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for templates in (licenses.TEMPLATES, many):
        found = {r["row"]["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan(docs, templates=templates).collect()}
        want = {i: brute.license_scan(t, licenses.PHRASES, templates, licenses.THRESHOLD)[5:] for i, t in enumerate(texts)}
        assert {i: x[0] for i, x in found.items()} == {i: x[0] for i, x in want.items()}
        assert all(abs(found[i][1] - want[i][1]) < 1e-12 for i in want)
        if templates is licenses.TEMPLATES:
            assert all(label in found[3 * i + k][0].split(",") for i, label in enumerate(templates) for k in range(3)) and not found[3 * len(templates)][1]


def test_license_lines(spark):
    lines = ["x\n" + t + "!" for t in licenses.TEMPLATES.values()] + ["ALL  RIGHTS-reserved all rights reservedly cc,by CC\nBY \U0001f600 cc by"]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    found = {r["row"]["doc_id"]: r for r in licenses.scan(docs).collect()}
    for i, label in enumerate(licenses.TEMPLATES):
        assert label in found[i]["labels"].split(",") and found[i]["score"] == 1.0
    last = found[len(lines) - 1]
    assert (last["n_base"], last["first_word"], last["last_word"], last["base_labels"]) == brute.license_scan(lines[-1], licenses.PHRASES, {}, 1)[1:5]


# WARC


def test_archive_round_trip(spark, tmp_path):
    pages = [(i, f"http://h/{i}\r\nX: y", "<p>same</p>" * (i % 3) + ("" if i % 3 else str(i)) + "é" * 50) for i in range(200)]
    pages += [(300, None, None), (301, "u", None), (None, "n", "<p>same</p>" + "é" * 50), (400, "z", "x" * 3_000_000), (None, "alone", "q")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    manifest = warc.write(warc.with_revisits(df), str(tmp_path))
    back = warc.read_back(manifest).collect()
    payload = lambda h: (h or "").encode()
    first = {}
    for p, _, h in pages:
        if p is not None:
            first[payload(h)] = min(p, first.get(payload(h), p))
    want = []
    for p, _, h in pages:
        f = first.get(payload(h))
        digest = base64.b32encode(hashlib.sha1(payload(h)).digest()).decode()
        want.append((p, len(payload(h)), digest, "response" if f in (p, None) else "revisit", None if f in (p, None) else f))
    same([(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in back], want)
    kept = {r["page_id"]: bytes(r["payload"]) for r in back if r["record_type"] == "response" and r["page_id"] is not None}
    assert all(v == payload(dict((p, h) for p, _, h in pages)[k]) for k, v in kept.items())
    some = next(tmp_path.glob("*.warc.zst")).read_bytes()
    assert some[:4] == warc.DICTIONARY_MAGIC.to_bytes(4, "little")
    assert warc.read_back(warc.write(warc.with_revisits(df.limit(0)), str(tmp_path / "none"))).count() == 0


def test_small_payloads_are_not_revisits(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    same([(r["page_id"], r["refers_to"]) for r in warc.with_revisits(df, min_bytes=3).collect()], [(1, None), (2, None), (3, None), (4, 3)])


# exact search


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 40)
    rng = np.random.default_rng(1)
    vectors = [(i, rng.normal(size=8).tolist()) for i in range(0, 900)]
    vectors += [(1_000 + i, [0.5] * 8) for i in range(300)]  # many equal vectors
    vectors += [(2_000, None), (2_050, [float("nan")] * 8), (2_100, [None] + [0.1] * 7), (2_150, [0.3] * 3), (2_200, []), (None, [1.0] * 8), (50, [0.5] * 8), (51, vectors[51][1])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumns({"v": F.lit(1), "block": F.lit("x")})
    good = [(i, [math.floor(256 * x) for x in v] + [0] * (8 - len(v))) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    m = np.array([v for _, v in good])
    ids = np.array([i for i, _ in good])
    want = []
    for q in sorted({i for i in ids.tolist() if i % 50 == 0}):
        best = {}
        for row in m[ids == q]:
            for i, s in zip(ids.tolist(), (m @ row).tolist(), strict=True):
                if i != q:
                    best[i] = max(s, best.get(i, s))
        want += [(q, n + 1, i, s) for n, (i, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:5])]
    same(topk.top_k(df).collect(), want)
    assert topk.top_k(df.limit(0)).count() == 0
    same(topk.top_k(df.where("vec_id in (100, 101)")).collect(), [(100, 1, 101, int(m[100] @ m[101]))])


# chat


def test_chat_windows(spark):
    rng = random.Random(7)
    pieces = ["a b c ", "<|im_end|>", "\\", "<|", "<\\|", "\n", "|>", "<", "é\U0001f600 ", "<|im_start|>assistant\n"]
    turns = []
    for c in [*range(12), None]:
        if rng.random() < 0.5:
            turns.append((c, 0, "system", "be <|kind|> " + "x " * rng.randrange(30)))
        for t in range(1, rng.randrange(2, 160)):
            turns.append((c, t, rng.choice(["user", "assistant", "odd\n<|role\\"]), "".join(rng.choices(pieces, k=rng.randrange(12)))))
    turns += [(90, 0, "user", "x " * 900), (90, 1, "assistant", "y " * 5_000), (90, None, "assistant", None), (91, 5, None, None), (92, 3, "user", "tie"), (92, 3, "user", "tie")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumns({"c": F.lit(1), "window": F.lit(2), "tokens": F.lit(3)})
    windows = chat.format_windows(df, budget=120, history=30)
    one_shuffle = chat.format_windows(df, budget=120, history=30, together=True)
    same(one_shuffle.collect(), [tuple(r) for r in windows.collect()])
    assert chat.read_back(one_shuffle)._jdf.queryExecution().executedPlan().toString().count("Exchange hash") == 1
    assert chat.format_windows(df.limit(0), together=True).count() == 0
    back = {r["conv_id"]: r for r in chat.read_back(windows).collect()}
    groups = defaultdict(list)
    for c, t, role, text in turns:
        groups[c].append((t is not None, t or 0, role or "", text or ""))
    assert set(back) == set(groups)
    for c, rows in groups.items():
        rows.sort()
        assert [tuple(x) for x in back[c]["turns"]] == [r[2:] for r in rows]
        assert back[c]["loss_text"] == "".join(r[3] for r in rows if r[2] == "assistant")
    for r in windows.collect():
        assert r["text"].count(chat.START) == r["n_repeated"] + r["n_new"]
        rows = sorted(groups[r["conv_id"]])
        if r["window"] and rows[0][2] == "system":
            assert r["text"].startswith("<|im_start|>system\nbe <\\|kind|> ")
    assert chat.format_windows(df.limit(0)).count() == 0


def plain_windows(sizes, has_system, budget, history, block):
    """(n_repeated, n_new) of each window, from the token counts of a conversation's turns."""
    starts = [sum(sizes[:i]) for i in range(len(sizes))]
    kept = sizes[0] if has_system else 0
    groups = []
    for i, (at, size) in enumerate(zip(starts, sizes)):
        begin = groups[-1][0] if groups else None
        room = budget if begin == 0 else budget - history - kept
        if begin is None or at // (block * budget) != starts[begin] // (block * budget) or at + size - starts[begin] > room:
            groups.append([])
        groups[-1].append(i)
    out = []
    for g in groups:
        left = min(history, budget - kept - sum(sizes[i] for i in g))
        past = [i for i in range(has_system, g[0]) if starts[i] >= starts[g[0]] - left]
        if g[0]:
            size = kept + sum(sizes[i] for i in past + g)
            assert size <= budget or (len(g) == 1 and not past)
        else:
            assert sum(sizes[i] for i in g) <= budget or len(g) == 1
        out.append((len(past) + (has_system if g[0] else 0), len(g)))
    return out


@pytest.mark.parametrize("together", [True, False])
def test_chat_windows_keep_their_budget(spark, together):
    rng = random.Random(3)
    convs = {}
    for c in range(25):
        sizes = [rng.choice([0, 1, 5, 20, 60, 150]) for _ in range(rng.choice([1, 2, 30, 400]))]
        if c == 3:
            sizes = [95, *sizes]  # a system turn that leaves no room for history
        if c == 4:
            sizes = [5, 9_000, 3, 3]  # a turn of several blocks
        convs[c] = (sizes, c % 2 == 1)
    rows = [(c, t, "system" if t == 0 and s else "user", f"{t}", n if n else None) for c, (sizes, s) in convs.items() for t, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n int")
    got = defaultdict(list)
    for r in sorted(chat.format_windows(df, 120, 30, together=together, tokens="n").collect(), key=lambda r: (r["conv_id"], r["window"])):
        got[r["conv_id"]].append((r["n_repeated"], r["n_new"]))
    for c, (sizes, s) in convs.items():
        assert got[c] == plain_windows([n + chat.OVERHEAD for n in sizes], int(s), 120, 30, chat.BLOCK), c


def test_chat_query_reads_the_planted_conversation(spark):
    r = queries.op2_chat_windows(spark, SF).where("conv_id = -1").first()
    text = queries.CONTROL
    assert (r["n_turns"], r["loss_chars"]) == (2, len(text))
    assert r["turns_sha256"] == brute.sha(f"user\n{text}\nassistant\n{text}\n") and r["loss_sha256"] == brute.sha(text)
