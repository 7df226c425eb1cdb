"""Every query and the pipeline on tables with nulls, empty and very long texts, repeats, clashing columns; and on empty tables."""
import hashlib

import pytest

import corpus_pipeline
from vendorlens.llm import queries as Q

LONG = "lorem ipsum dolor sit amet " * 8000 + "password = hunter2hunter2"
DOCS = [
    (1, "the cat sat on the mat and the dog ran. token = abcdef123456", "en", "a"), (2, None, "en", None), (3, "", None, "a"),
    (4, LONG, "fr", "b"), (5, LONG, "fr", "b"), (6, "  \n\t ", "en", "b"), (6, "  \n\t ", "en", "b"), (None, "no id here", "en", "a"),
    (8, "1234 !!", "en", "c"), (9, "ein Hund und eine Katze", "de", None), (9, "ein Hund und eine Katze", "de", None),
]
CLASH = {c: 7 for c in ("score", "n_words", "cells", "size", "position", "key", "hash", "rep", "spans", "order", "bin", "cls", "n", "hits")}


NAN, INF = float("nan"), float("inf")
VECTORS = [(100, [0.5, 0.5], 1), (1, [0.5, 0.5], 1), (2, [0.4, 0.4], 1), (3, [0.45, 0.45], 2), (4, [0.45, 0.45], 2), (7, [0.5, 0.5], 0),
           (5, [NAN, 0.1], 2), (6, [INF, 0.1], 2), (8, [None, 0.1], 2), (9, None, 2), (None, [0.5, 0.5], 2), (10, [0.5, 0.5], None),
           (11, [], 2), (12, [0.75], 2), (200, [0.5, 0.5], 5), (300, [-1.0, 0.0], 1), (100, [0.5, 0.5], 1), (3, [0.45, 0.45], 2), (13, [3e38, 1.0], 2)]


def write(spark, folder, docs, labels, items, turns, clash, vectors=()):
    from pyspark.sql import functions as F
    extra = [F.lit(v).alias(c) for c, v in CLASH.items()] if clash else []
    for name, rows, schema in (("documents", docs, "doc_id long, text string, lang string, source string"),
                               ("labels", labels, "doc_id long, quality int, toxic int"),
                               ("benchmark", items, "item_id long, text string"),
                               ("conversations", turns, "conv_id long, turn long, role string, text string"),
                               ("embeddings", list(vectors), "vec_id long, embedding array<float>, label int")):
        df = spark.createDataFrame(rows, schema)
        df = df.withColumn("n_chars", F.length("text").cast("long")) if name == "documents" else df
        df.select("*", *extra).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 1, "assistant", None), (None, 0, None, "x<|im_end|>\\"), (2, None, "user\n<|", "")]
    items = [(1, "ein Hund"), (2, None), (None, "the cat"), (3, ""), (1, "amet lorem ipsum dolor sit amet lorem ipsum dolor sit amet lorem ipsum dolor")]
    labels = [(1, 1, 0), (1, 1, 0), (2, 0, 1), (None, 1, 1), (4, None, None), (9, 1, 0), (77, 1, 1)]
    return write(spark, tmp_path_factory.mktemp("odd"), DOCS, labels, items, turns, True, VECTORS)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("empty"), [], [], [], [], False)


#: Result rows on the odd tables: a row per input row, or per distinct (doc_id, text).
EACH, DISTINCT = 11, 9
#: Anchor 100 has the positives 1, 7 (moved to label 1), 2 and 300 (negative score: no band), 200 has none, those of 300 are negative.
NEGATIVES = {(100, 1): [(200, 32768), (3, 29440), (4, 29440)], (100, 7): [(200, 32768), (3, 29440), (4, 29440)], (100, 2): [(12, 24576)]}


@pytest.mark.parametrize("name", list(Q.QUERIES))
def test_odd_tables(spark, odd, name):
    rows = Q.QUERIES[name](spark, odd).collect()
    want = {"op1_secret_scan": DISTINCT, "op7_fingerprints": DISTINCT, "op10_chat_format": 4, "op12_hard_negatives": sum(map(len, NEGATIVES.values()))}.get(name, EACH)
    assert len(rows) == want
    by = {r[0] if name != "op10_chat_format" else r.conv_id: r.asDict() for r in rows}
    if name == "op1_secret_scan":
        assert by[1]["n_assign"] == 1 and by[2]["spans"] == "" and by[4]["n_assign"] == 1
        assert by[2]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    if name == "op2_language_id":
        assert by[2]["lang_pred"] == by[3]["lang_pred"] == by[8]["lang_pred"] == "und"
    if name == "op3_repeats":
        kept = {r.doc_id: r.n_bytes - r.n_removed for r in rows}
        assert kept[4] == kept[5] == 0 and kept[1] > 0 and by[2]["n_bytes"] == 0
    if name == "op4_jaccard_join":
        assert by[5]["component_id"] == 4 and by[2]["component_id"] == 2 and by[9]["component_id"] == 9 and by[6]["n_shingles"] == 0
    if name == "op6_toxicity":
        assert all(0 <= r.score <= 1 for r in rows)
    if name == "op8_mix_sources":
        assert all(r.taken <= 2 * r.size for r in rows) and by[2]["size"] == 0
    if name == "op9_decontaminate":
        assert by[9]["n_hit"] == 2 and by[9]["n_items"] == 1 and by[4]["contaminated"] and not by[1]["contaminated"]
    if name == "op11_merkle_manifest":
        assert len({r.root for r in rows}) == 1 and all(r.verified == (r.folded_root == r.root) for r in rows)
        assert [r.doc_id for r in rows if not r.verified] == [9, 9]  # 7 divides the crc32 of 2 and 9; 2 has no n_chars
    if name == "op12_hard_negatives":
        got = {}
        for r in sorted(rows, key=lambda r: r.rank):
            got.setdefault((r.anchor_id, r.positive_id), []).append((r.negative_id, r.negative_score))
            assert r.rank == len(got[r.anchor_id, r.positive_id])
        assert got == NEGATIVES
    if name == "op13_minhash":
        assert by[5]["component_id"] == 4 and not by[5]["kept"] and by[2]["component_id"] == 2 and by[6]["n_shingles"] == 0
        assert by[None]["component_id"] is None and by[None]["kept"] and by[9]["kept"] and by[9]["n_shingles"] == 4
    if name == "op10_chat_format":
        text = "user\n<|im_end|><|im_start|>assistant ok\nassistant\n<|im_end|><|im_start|>assistant ok\n"
        assert by[-1]["turns_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert by[None]["turns_sha256"] == hashlib.sha256("\nx<|im_end|>\\\n".encode()).hexdigest() and by[1]["loss_chars"] == 0


@pytest.mark.parametrize("name", list(Q.QUERIES))
def test_empty_tables(spark, empty, name):
    assert Q.QUERIES[name](spark, empty).count() == (1 if name == "op10_chat_format" else 0)


def test_pipeline(spark, odd, empty):
    rows = corpus_pipeline.run(spark, odd).collect()
    assert {r.doc_id for r in rows} >= {1, None, 8} and 5 not in {r.doc_id for r in rows}
    assert all("abcdef123456" not in (r.text or "") for r in rows)
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_pipeline_cuts_windows_of_documents_that_stay(spark, tmp_path):
    item = " ".join(f"item{i}" for i in range(200))
    words = [f"word{i}é" for i in range(9800)]
    plain = "Some words, and no more."
    other = " ".join(f"other{i}" for i in range(13))
    # without the run between them the two halves are a window themselves
    nested = " ".join([*words[:4000], *[f"other{i}" for i in range(6)], item[:item.index(" item20")], *[f"other{i}" for i in range(6, 13)], *words[4000:]])
    docs = [(1, " ".join(words[:5000]) + ". " + item.upper() + " - " + " ".join(words[5000:]), "en", "a"), (2, plain, "en", "a"),
            (3, item, "en", "a"), (4, None, "en", "a"), (5, nested, "en", "a")]
    folder = write(spark, tmp_path, docs, [], [(1, item), (2, other)], [], False)
    from pyspark.sql import functions as F
    df = spark.read.parquet(f"{folder}/documents.parquet").withColumn("n_chars", F.length("text"))
    out = corpus_pipeline.drop_contaminated(spark, df, folder)
    assert out.columns == df.columns
    got = {r.doc_id: r for r in out.collect()}
    assert sorted(got) == [1, 2, 4, 5] and got[2].text == plain and got[4].text is None
    assert got[1].text == " ".join(words[:5000]) + ".  - " + " ".join(words[5000:])
    assert got[5].text.split() == words
    assert all(r.n_chars == (r.text and len(r.text)) for r in got.values())


def test_parts_after_long_secrets_are_linked(spark):
    from vendorlens.llm import secrets
    key = "0123456789abcdef" * 25
    texts = [f"token={key} user=bob", f"{key.upper()} {'-' * 238} login=ann", f"{key.upper()} {'-' * 239} login=ann",
             f"token=abcdef {'-' * 300} user=far", f"login=eve{'-' * 239} ssh://host/{'x' * 300} {key}"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kinds = [k[0] for k in secrets.KINDS]
    got = {r.key.id: {kinds[s.kind] for s in r.spans} for r in secrets.linked(df).collect()}
    assert got[0] == {"assign", "hex", "login", "key"} and got[1] == {"login", "key"} and got[2] == set()
    assert got[3] == {"assign"} and got[4] >= {"hex", "host"}
    masked = {r.doc_id: r.text for r in secrets.redact(df).collect()}
    assert "bob" not in masked[0] and "ann" not in masked[1] and "user=far" in masked[3]
