"""Exact dedup, the Merkle manifest and the prefix trie against plain versions."""

import random
import zlib

import brute
import pytest
from pyspark.sql import functions as F

from pitline.llm import chat, exact_dedup, merkle, prefix_trie, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TURNS = "conv_id long, turn long, role string, text string"
LONG = "Ab c" * 30_000
EDGE = [
    (1, "Same text", "en", "a"),
    (2, "sAME TEXT", "en", None),
    (2, "sAME TEXT", "en", None),  # a repeated row
    (3, "same texs", "en", "a"),  # as long, another end
    (4, "ÄB", "de", "a"),
    (5, "äb", "de", "a"),  # only A-Z are lowered
    (6, "K", "de", "é"),
    (7, "k", "de", "é"),
    (8, None, None, None),
    (9, "", None, ""),
    (None, "same text", "fr", "a"),
    (None, None, "fr", "a"),
    (10, LONG, "fr", "b"),
    (11, LONG.lower(), "fr", "b"),
    (12, LONG[:-1] + "d", "fr", "b"),  # differs behind the prefix alone
    (-13, LONG, None, "b"),
]
CLASHES = ("row", "key", "n", "full", "best", "at", "kept", "tree", "pos", "leaf", "other", "digest", "id", "mask", "same_length", "part", "first")


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(*r, len(r[1] or "")) for r in EDGE], DOCS).withColumns({c: F.lit(i) for i, c in enumerate(CLASHES)})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_exact_groups_at_the_edges(edge):
    wanted = brute.equal_groups([(r[0], r[1]) for r in EDGE])
    found = exact_dedup.groups(edge).collect()
    assert len(found) == len(EDGE)
    kept = {}
    for r in found:
        text = brute.ascii_lower(r["row"]["text"] or "")
        assert (r["keep_id"], r["group_size"]) == wanted[text]
        assert not r["kept"] or r["row"]["doc_id"] == r["keep_id"]
        kept[text] = kept.get(text, 0) + r["kept"]
    assert set(kept.values()) == {1}
    survivors = exact_dedup.drop_copies(edge)
    assert survivors.columns == edge.columns and survivors.count() == len(wanted)


def test_exact_groups_with_full_bitmaps(edge):
    """Every bit set: all texts are hashed, and the groups are the same."""
    wanted = brute.equal_groups([(r[0], r[1]) for r in EDGE])
    for r in exact_dedup.groups(edge, bits=64).collect():
        assert (r["keep_id"], r["group_size"]) == wanted[brute.ascii_lower(r["row"]["text"] or "")]


def test_exact_groups_of_nothing(empty):
    assert exact_dedup.groups(empty).count() == 0
    assert exact_dedup.drop_copies(empty).count() == 0


def test_one_group_of_nearly_all_rows(spark):
    docs = spark.range(3_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 < 9, F.lit("Copy")).otherwise(F.concat(F.lit("t"), F.col("id"))).alias("text"))
    found = exact_dedup.groups(docs)
    assert found.where("group_size = 2700 AND keep_id = 2998").count() == 2_700
    assert found.where("kept").count() == 301


def record(values):
    return "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def manifest_of(docs, **more):
    values = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    lowered = merkle.record([*values[:-1], F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")])
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return merkle.manifest(docs, values, changed=F.when(chosen, lowered), **more)


def plain_manifest(rows):
    leaves = []
    for i, text, lang, source, n in rows:
        tampered = i is not None and zlib.crc32(str(i).encode()) % 5 == 0
        low = None if text is None else brute.ascii_lower(text)
        leaves.append((i, source, brute.sha(record((i, source, lang, n, text))), brute.sha(record((i, source, lang, n, low))) if tampered else None))
    return brute.merkle(leaves)


def same(found, wanted):
    order = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(tuple, found), key=order) == sorted(map(tuple, wanted), key=order)


RESULT = ("id", "leaf", "subroot", "root", "proof_sha256", "folded_root")


def test_manifest_at_the_edges(edge, empty):
    rows = [(*r, len(r[1] or "")) for r in EDGE]
    same(manifest_of(edge).select(*RESULT).collect(), plain_manifest(rows))
    assert manifest_of(empty).count() == 0
    one = manifest_of(edge.where("doc_id = 10")).collect()  # a lone leaf is subroot and root
    assert one[0]["leaf"] == one[0]["root"] == one[0]["subroot"]


@pytest.mark.parametrize("levels", [1, 3])
def test_manifest_over_several_rounds(spark, levels):
    """Blocks of 16 leaves need several rounds; blocks of 4096 one."""
    rng = random.Random(7)
    rows = [(i, f"Text {rng.random()}", None, rng.choice(["hot", "hot", "hot", *"abcdefghijklmnopqrstuvw", None]), i) for i in range(1_000)]
    rows += [(5_000 + i, "T", "en", "lone" + str(i), None) for i in range(3)]
    found = manifest_of(spark.createDataFrame(rows, DOCS), proofs=True, height=levels).collect()
    same([[r[c] for c in RESULT] for r in found], plain_manifest(rows))
    for r in found:
        assert r["verified"] == (not r["copies"]) and (not r["copies"] or r["copies"][-1] == r["folded_root"])
        assert brute.sha("".join(s["before"] + s["after"] for s in r["proof"])) == r["proof_sha256"]
    assert {len(r["copies"]) for r in found} - {0}  # versions copy one node a level
    assert all(len(r["copies"]) == len(r["proof"]) for r in found if r["copies"])


def turn_id(row):
    role, text = row[2] or "", row[3] or ""
    return brute.sha(f"{len(role.encode())}:{role}{text}")


def rebuilt(rows):
    turns = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", turn_id(r))):
        turns.setdefault(c, []).append((role or "", text or ""))
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = turns.get(c - c % 5, [])[:h] + own[h:]
    return out


NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


@pytest.mark.parametrize("seed", range(4))
def test_trie_against_definition(spark, seed):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(90), 60):
        for t in range(rng.choice([1, 2, 3, 8, 12])):
            rows.append((c, t if rng.random() < 0.9 else None, rng.choice(["user", "é", None]), rng.choice(["a", "bc", None, ""])))
    rows += [(c, t, "user", "the same") for c in range(100, 125) for t in range(1 + c % 2 * 10)]  # many equal ones
    rows += [(300, t, "user", "deep" * 1_000) for t in range(150)] + [(301, t, "user", "deep" * 1_000) for t in range(149)] + [(None, 0, "user", "none")]
    got = prefix_trie.trie(prefix_trie.forked(prefix_trie.sequences(spark.createDataFrame(rows, TURNS))), stripe=[64, 2, 3, 1][seed]).select(*NODE).collect()
    same(got, brute.trie(rebuilt(rows)))


def test_trie_of_many_shards(spark):
    """More shards than groups of equal conversations: nodes cross many shards, and shards hold single rows."""
    rows = [(c, t, "user", f"t{t if t < 2 else c % 3}") for c in range(40) for t in range(c % 4)] + [(c, 0, "user", "t0") for c in range(0, 40, 4)]
    convs = prefix_trie.sequences(spark.createDataFrame(rows, TURNS))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "60")
        got = prefix_trie.trie(convs).select(*NODE).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    plain = {}
    for c, t, role, text in rows:
        plain.setdefault(c, []).append((t, role, text))
    same(got, brute.trie({c: [x[1:] for x in sorted(v)] for c, v in plain.items()}))


def test_trie_of_nothing(spark):
    nothing = prefix_trie.sequences(spark.createDataFrame([], TURNS).withColumn("id", F.lit(1)))
    assert prefix_trie.trie(prefix_trie.forked(nothing)).count() == 0


def test_turnless_conversations(spark):
    """Without its family's first one a conversation of few turns is left with none and is a member of the root."""
    few = [(c, 0, "user", "x") for c in range(1, 5)]
    got = prefix_trie.trie(prefix_trie.forked(prefix_trie.sequences(spark.createDataFrame(few, TURNS)))).select(*NODE).collect()
    same(got, brute.trie(rebuilt(few)))
    assert got[0]["depth"] == 0 and got[0]["n_convs"] == 4


@pytest.mark.parametrize("together", [True, False])
def test_roles_and_texts_of_a_megabyte(spark, together):
    role, text = "r\\<|\n" * 200_000, "t\\<|im_end|>\n" * 80_000
    turns = spark.createDataFrame([(1, 0, role, "short"), (1, 1, "assistant", text), (2, 0, "", ""), (2, 1, "assistant", "\\")], TURNS)
    back = {r["conv_id"]: r for r in chat.read_back(chat.format_windows(turns, together=together)).collect()}
    assert [tuple(t) for t in back[1]["turns"]] == [(role, "short"), ("assistant", text)] and back[1]["loss_text"] == text
    assert [tuple(t) for t in back[2]["turns"]] == [("", ""), ("assistant", "\\")] and back[2]["loss_text"] == "\\"


def test_no_local_folder_on_a_cluster(spark):
    """Without a shared folder only a session on one machine gets one of its own."""
    from pitline.llm.common import shared_dir

    class Conf:
        def __init__(self, **settings):
            self.settings = {k.replace("_", "."): v for k, v in settings.items()}

        def get(self, key, default=None):
            return self.settings.get(key, default)

        def set(self, key, value):
            self.settings[key] = value

    class Session:
        def __init__(self, **settings):
            self.conf = Conf(**settings)

    for master in ("spark://host:7077", "yarn", "k8s://host", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            shared_dir(Session(spark_master=master))
    assert shared_dir(Session(spark_master="yarn", spark_checkpoint_dir="hdfs:///shared/")) == "hdfs:///shared"
    assert shared_dir(Session(spark_master="local[4]")).startswith("/tmp/")


def test_pipeline_from_end_to_end(spark, tmp_path):
    """Every stage on a small table with copies, outliers of the rules, personal data and nulls; each one's result follows from what came in."""
    import corpus_pipeline

    rng = random.Random(3)
    words = [f"word{i}" for i in range(400)]
    rows = []
    for i in range(60):
        text = " ".join(rng.choices(words, k=80)) + ".\n"
        rows.append((i, text, "en", rng.choice("ab"), len(text)))
        if i % 6 == 0:  # a near copy, an exact one and a repeated row
            copy = text.replace(text.split()[40], "other", 1)
            rows += [(1_000 + i, copy, "en", "a", len(copy)), (2_000 + i, text, "en", "b", len(text)), rows[-1]]
    secret = " ".join(rng.choices(words, k=60)) + " mail anna.b@example.com or +1 415 555 2671"
    rows += [(3_000, secret, "en", "a", len(secret)), (3_001, None, "en", "a", None), (3_002, "too short", None, None, 9), (None, secret + " x", None, "b", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    seen, got = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        seen = stage(spark, seen, str(tmp_path)).cache()
        got[name] = [r.asDict() for r in seen.collect()]
        if name != "encoding":
            assert set(seen.columns) == set(docs.columns)
    kept = {r["doc_id"] for r in got["quality rules"]}
    assert {3_001, 3_002}.isdisjoint(kept) and len(got["quality rules"]) == len(rows) - 2
    ids = [r["doc_id"] for r in got["near duplicates"]]
    assert sorted(ids) == [*range(60), 3_000]  # copies, and the null id, give way to the smallest one
    clean = {r["doc_id"]: r["text"] for r in got["private data"]}
    assert len(clean) == len(ids) and "anna.b" not in clean[3_000] and "[EMAIL]" in clean[3_000] and "[PHONE]" in clean[3_000]
    assert all(clean[i] == dict((r[0], r[1]) for r in rows)[i] for i in range(60))
    assert {r["doc_id"] for r in got["encoding"]} == {r["doc_id"] for r in got["mixing"]} <= set(clean)
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert again.count() == len(got["encoding"]) and set(again.columns) == {"doc_id", "source", "lang", "n_tokens", "input_ids"}


def test_pipeline_stages_on_an_empty_table(spark, empty):
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0, name


def test_archives_are_read_in_as_many_tasks(spark, tmp_path):
    pages = spark.range(400).select(F.col("id").alias("page_id"), F.lit("http://x").alias("url"), F.repeat(F.col("id").cast("string"), 50).alias("html")).repartition(6)
    manifest = warc.write(warc.with_revisits(pages), str(tmp_path / "archives"), warc.payloads(pages))
    back = warc.read_back(manifest)
    tasks = back.select(F.spark_partition_id().alias("task"), "page_id").groupBy("task").count().count()
    assert back.count() == 400 and tasks >= 0.7 * manifest.count() > 1


def test_license_scan_looks_for_phrases_and_lines_only_where_their_words_stand(spark):
    """words are taken once a text, also for their number; lines are parted and phrases searched only in texts that hold their words."""
    from pitline.llm import licenses

    texts = ["CC  by, cc-BY", "Kİ x_y Z9é", "accby cc bye", "All Rights\nreserved. GENERAL public-license", "Released under the\nMIT license", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = licenses.scan(docs)
    got = {r.row.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in found.collect()}
    assert got[0] == (4, 2, 0, 2, "cc-by", "cc-by") and got[1] == (4, 0, None, None, "", "")
    assert got[2] == (3, 0, None, None, "", "") and got[3] == (6, 2, 0, 3, "gpl,reserved", "gpl,reserved")
    assert got[4][:2] == (5, 0) and got[4][5] == "mit-statement" and got[5] == got[6] == (0, 0, None, None, "", "")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN arrays_overlap(words" in plan and "CASE WHEN (array_contains(words" in plan
    assert {r.row.doc_id: r.n_base for r in licenses.scan(docs, templates={}).collect()}[0] == 2
