import hashlib
import re
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from tallyweave.llm import _shared, queries
from tallyweave.llm._shared import Scratch

from .test_operators import DOCS, docs, empty, frame, plain_simhash, plain_targets, run_sql, union_find, words  # noqa: F401


def test_stages_keep_columns_and_take_effect(spark, docs):
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = now
        now = Scratch(spark, "test").keep(stage(spark, before, None), name, files_a_core=None)
        assert now.columns == before.columns, name
        texts = [r["text"] for r in now.collect()]
        if name == "language_id":
            assert all(t and re.search(r"[^\W\d_]", t) for t in texts) and now.count() == before.count() - 3
        elif name == "simhash_dedup":
            left = [r["doc_id"] for r in now.collect()]
            assert 6 in left and not {7, 8} & set(left) and left.count(None) == 0
        elif name == "secret_scan":
            assert now.count() == before.count() and not any("c4d0e4e2" in t for t in texts)
            assert all(r["n_chars"] == len(r["text"]) for r in now.collect())
        elif name == "mixing":
            assert max(Counter(r["doc_id"] for r in now.collect()).values()) <= 2
    packed = corpus_pipeline.STAGES[-1][1](spark, now, None)
    assert packed.agg(F.sum("length")).first()[0] == sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in now.collect())


def test_run_equals_brute_force(spark, tmp_path, docs):
    """All stages written apart: plain fingerprints, patterns, queue, and packing as SQL."""
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path))
    rows = [r.asDict() for r in docs.collect()]
    # Language: no letter, no language. Near copies: one row of each group, told apart by the whole row.
    rows = [r for r in rows if re.search(r"[^\W\d_]", r["text"] or "")]
    keys = marks_of(spark, rows)
    prints = [plain_simhash(r["text"]) for r in rows]
    root = union_find(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if bin(prints[a] ^ prints[b]).count("1") <= 2])
    first = {}
    for i in sorted(range(len(rows)), key=lambda i: (rows[i]["doc_id"] is None, rows[i]["doc_id"] or 0, keys[i])):
        first.setdefault(root[i], i)
    rows = [rows[i] for i in first.values()]
    # Secrets: one document has one, an assignment over a hex string.
    for r in rows:
        r["text"] = re.sub(r'token = "[0-9a-f]{40}', "[SECRET]", r["text"])
        r["n_chars"] = len(r["text"])
    # Mixing: uses by finish time until the targets together are reached.
    keys, sizes = marks_of(spark, rows), Counter()
    for r in rows:
        sizes[r["source"]] += len(words(r["text"]))
    targets, uses = plain_targets(sizes), []
    for s, target in targets.items():
        own = sorted((hashlib.md5(str("" if r["doc_id"] is None else r["doc_id"]).encode()).hexdigest(), r["doc_id"] is not None, r["doc_id"] or 0, k, i) for i, (r, k) in enumerate(zip(rows, keys)) if r["source"] == s)
        at = 0
        for epoch in range(2 if target else 1):
            for order, named, doc, key, i in own:
                at += len(words(rows[i]["text"]))
                uses.append((at / target if target else epoch, s or "", s is None, epoch, order, named, doc, key, i))
    mixed, ahead = [], 0
    for use in sorted(uses):
        r = rows[use[-1]]
        if ahead < round(sum(targets.values()), 3) or not targets[r["source"]]:
            mixed.append((r["doc_id"], r["text"], None, r["source"]))
        ahead += len(words(r["text"]))
    names = ["doc_id", "piece", "length", "bucket", "boundary", "batch"]
    expected = run_sql(f"select {', '.join(names)} from ({queries.packing_sql()})", frame(mixed)).fetchall()
    assert found.columns == names
    assert sorted(map(repr, (tuple(r) for r in found.collect()))) == sorted(map(repr, expected))


def marks_of(spark, rows):
    """The hashes that order rows of one id."""
    numbered = spark.createDataFrame([(*r.values(), i) for i, r in enumerate(rows)], DOCS + ", _at int")
    marks = _shared.row_marks(numbered.drop("_at"))
    return [tuple(r["m"]) for r in numbered.select("_at", F.array(*marks).alias("m")).orderBy("_at").collect()]


def test_empty_documents(spark, tmp_path, empty):
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stage_order_is_fixed():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_dedup", "secret_scan", "mixing", "packing"]
