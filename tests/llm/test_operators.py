"""Operators against brute force on fixtures with nulls, blanks, long texts, ties,
repeated rows, clashing extra columns, and on empty tables."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyweave.llm import chat_format, language_id, media, mixing, packing, pii, queries, secret_scan, simhash, token_counts, vector_dedup
from tallyweave.llm import _shared, _spans
from tallyweave.llm.vector_dedup import Settings

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, row long, fp long, bucket int, `order` string, found string, step int"
WORDS = "the of and to in is that for it as was with be by on".split()
SPANISH = "el la de que y en un ser se no haber por con su para".split()


def prose(rng, n, words=WORDS):
    return " ".join(rng.choice(words) for _ in range(n)) + "."


def documents():
    """Edge cases: (doc_id, text, lang, source)."""
    rng = random.Random(4)
    base = prose(rng, 80)
    rows = [
        (1, None, None, None), (2, "", "en", "a"), (3, " \t\n ", "en", None), (4, "word", "en", "a"), (5, "two words", None, "b"),
        (6, base, "en", "a"), (7, base, "en", "b"), (7, base, "en", "b"), (8, base.upper(), "en", "b"),
        (9, base.replace("of", "off", 1), "en", "c"), (None, base, "en", "c"), (10, "x" * 200_000, "en", "a"), (11, prose(rng, 60_000), "en", "a"),
        (12, "12345 67890 !!! 日本", None, "日"), (13, prose(rng, 40, SPANISH), "es", ""), (14, "line\x00with nul é ü", "es", "a"),
        (15, "token = \"c4d0e4e2afd97eac40cbfd290a54a9cbdf355ce1\" mail a.b@c.de +1 (269) 555-3296", "en", "a"),
    ]
    rows += [(100 + i, prose(rng, 30 + i % 7, WORDS if i % 3 else SPANISH), "en" if i % 3 else "es", "abc"[i % 3]) for i in range(60)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, lang, s, len(t or ""), 1, 2, 3, 4, "o", "f", 5) for i, t, lang, s in documents()]
    return spark.createDataFrame(rows, DOCS).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


# --- shared -------------------------------------------------------------------------------


def union_find(n, links):
    root = list(range(n))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return [top(x) for x in range(n)]


@pytest.mark.parametrize("kind", ["random", "chain", "star", "none"])
def test_components(spark, kind):
    rng = random.Random(kind)
    links = {"random": [(rng.randrange(60), rng.randrange(60)) for _ in range(45)], "chain": [(i, i + 1) for i in range(40)], "star": [(0, i) for i in range(1, 40)] + [(50, 50)], "none": []}[kind]
    found = _shared.components(spark.createDataFrame(links, "a long, b long"), _shared.Scratch(spark, "test"))
    expected = union_find(60, links)
    assert {r["node"]: r["root"] for r in found.collect()} == {x: expected[x] for pair in links if pair[0] != pair[1] for x in pair}


def test_join_copies_is_a_left_join(spark):
    keys = [k for k in range(3000)] + [7] * 2000 + [8] * 3
    rows = spark.createDataFrame(list(enumerate(keys)), "id long, k long")
    copies = Counter(keys)
    found = spark.createDataFrame([(k, k * 2, copies[k]) for k in range(2900)], "k long, v long, n long")
    joined = _shared.join_copies(rows, found, ["k"], "n", _shared.Scratch(spark, "test"))
    assert joined.columns == ["k", "id", "v"]
    assert rows_of(joined, "id", "k", "v") == sorted(((i, k, 2 * k if k < 2900 else None) for i, k in enumerate(keys)), key=repr)


def test_redaction_covers_overlaps():
    assert _spans.cover("abcdefghij", [("x", 1, 4), ("y", 2, 6), ("z", 8, 9)], "#") == "a#gh#j"
    assert _spans.cover("abc", [], "#") == "abc" and _spans.cover("abc", [("x", 0, 3)], "#") == "#"


# --- 1 secret scans -------------------------------------------------------------------------

_KEYS = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def plain_secrets(text):
    out = [("assign", m.start(), m.end()) for m in _KEYS.finditer(text) if len(m[2]) >= 12]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out, key=lambda s: (s[1], secret_scan.BASE.index(s[0])))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["token", "secret", "PassWord", "api_key", "apikey", ":", "=", '"', " ", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef", "é", "x", "-", "\n", "ſecret"]), max_size=14))
def test_base_secrets_are_those_of_the_patterns(parts):
    text = "".join(parts)
    assert [s for s in secret_scan.Scanner().find(text) if s[0] in secret_scan.BASE] == plain_secrets(text)


@settings(max_examples=150, deadline=None)
@given(st.text("abcdef0123456789", max_size=90), st.integers(2, 30), st.sampled_from([1.0, 2.0, 2.5, 3.0]))
def test_entropy_windows(text, window, bits):
    marked = set()
    for i in range(len(text) - window + 1):
        counts = Counter(text[i : i + window])
        if -sum(c / window * np.log2(c / window) for c in counts.values()) >= bits + 1e-9:
            marked |= set(range(i, i + window))
    found = {x for a, b in secret_scan.entropy_spans(text, window, bits - 1e-9) for x in range(a, b)}
    assert marked <= found


def test_entropy_and_allow_list():
    kinds = lambda t: {s[0] for s in secret_scan.Scanner().find(t)}
    assert "ent_b64" in kinds("key qR7xT2mVb9LkPz4WsYd8Hn3JcFgUe6Aa1Bo5")
    assert not kinds("id 123e4567-e89b-12d3-a456-426614174000 and example_abcdefgh12345678qrstuvwx")
    assert not kinds("z" * 5000 + " " + "-" * 5000 + " the/quick/brown/fox/jumps/over/the/lazy/dog")


def test_secret_query_and_redaction(spark, docs, empty):
    found = docs.select("doc_id", "text", secret_scan.secret_spans(F.col("text")).alias("s")).collect()
    for r in found:
        base = [(s["kind"], s["start"], s["end"]) for s in r["s"] if s["kind"] in secret_scan.BASE]
        assert base == plain_secrets(r["text"] or "")
    clean = {r["doc_id"]: r["t"] for r in docs.select("doc_id", secret_scan.without_secrets(F.col("text")).alias("t")).collect()}
    assert clean[1] is None and clean[2] == "" and "c4d0e4e2" not in clean[15] and "[SECRET]" in clean[15]
    assert empty.select(secret_scan.secret_spans(F.col("text"))).count() == 0


def test_secret_digest_columns(spark, tmp_path, docs):
    """The query's own columns against the patterns and entropy windows, on whole texts."""
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.op1_secret_scan(spark, str(tmp_path)).collect()
    texts = defaultdict(list)
    for i, text, _, _ in documents():
        texts[i].append(text or "")
    assert Counter(r["doc_id"] for r in found) == {i: len(t) for i, t in texts.items()}
    scanner = secret_scan.Scanner()
    for r in found:
        text = texts[r["doc_id"]][0]
        base = plain_secrets(text)
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == kind for k, _, _ in base) for kind in secret_scan.BASE]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        every = sorted({*base, *scanner.entropy(text)}, key=lambda x: (x[1], scanner.kinds.index(x[0]), x[2]))
        assert r["spans"] == ",".join(f"{k}:{a}:{b}" for k, a, b in every)


def test_a_placeholder_word_does_not_hide_its_neighbours():
    key = "qR7xT2mVb9LkPz4WsYd8Hn3JcFgUe6Aa1Bo5Kp2M"
    scanner = secret_scan.Scanner()
    for text, hit in ((f"host.io/example-service/keys/{key}", True), (f"{key}/your_key", True), (f"example{key}", False), ("k3Tz8Qw1Lm5Vx9Rb2Yn7", True)):
        spans = [s for s in scanner.find(text) if s[0] == "ent_b64"]
        assert bool(spans) == hit and all("example" not in text[a:b] and "your" not in text[a:b] for _, a, b in spans)


# --- 2 vectors --------------------------------------------------------------------------------


def plain_vectors(rows, limit=0.93):
    ok = {}
    for place, (i, e, lab) in enumerate(rows):
        if i is not None and lab is not None and e and None not in e and all(np.isfinite(e)) and any(e):
            ok[place] = np.array(e, float) / np.linalg.norm(np.array(e, float))
    links, counts = [], Counter()
    for a in ok:
        for b in ok:
            if a < b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]) and ok[a] @ ok[b] >= limit:
                links.append((a, b))
                counts[a] += 1
                counts[b] += 1
    root = union_find(len(rows), links)
    least = defaultdict(lambda: 1 << 60)
    for place in ok:
        least[root[place]] = min(least[root[place]], rows[place][0])
    return [(i, counts[p], least[root[p]] if p in ok else i) for p, (i, _, _) in enumerate(rows)]


def vectors(rng, n=240, dims=16):
    rows = []
    for i in range(n):
        base = rng.normal(size=dims) if i < 60 or i % 3 == 0 else np.array(rows[rng.integers(len(rows) // 2)][1])
        rows.append((i, [float(np.float32(x)) for x in base + rng.normal(size=dims) * 0.08 * (i % 3 > 0)], int(i % 3)))
    rows += [(n + k, rows[5][1], rows[5][2]) for k in range(4)]
    rows += [(900, None, 1), (901, [], 1), (902, [0.0] * dims, 1), (903, [float("nan")] * dims, 1), (904, [float("inf")] + [1.0] * (dims - 1), 1), (905, [None] + [1.0] * (dims - 1), 1), (906, rows[5][1], None), (None, rows[5][1], rows[5][2]), (907, rows[5][1][:8], rows[5][2]), (5, rows[5][1], rows[5][2]), (3, rows[7][1], rows[7][2]), (3, rows[11][1], rows[11][2])]
    return rows


@pytest.mark.parametrize("settings_", [Settings(), Settings(shard=24, overlap=3, sample=200), Settings(shard=12, fanout=4), Settings(exact=True)])
def test_vectors_equal_brute_force(spark, settings_):
    rows = vectors(np.random.default_rng(8))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit(1)).withColumn("block", F.lit("x"))
    found = vector_dedup.near_duplicates(df, spark, settings_).collect()
    expected = sorted(plain_vectors(rows), key=repr)
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in found), key=repr) == expected
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found if r["vec_id"] is not None)
    assert {r["audited_recall"] for r in found} == {1.0}


def test_unusable_vectors_take_no_links_of_others(spark):
    rows = [(1, [1.0, 0.0], 0), (2, [1.0, 0.01], 0), (3, [None, 1.0, 0.0], 0), (4, [1.0, None, 0.0], 0), (5, [1.0, -0.0], 0), (6, [1.0, 0.0], None)]
    found = vector_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), spark).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in found) == [(1, 2, 1), (2, 2, 1), (3, 0, 3), (4, 0, 4), (5, 2, 1), (6, 0, 6)]


def test_no_vectors(spark):
    assert vector_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"), spark).count() == 0


def test_dense_group_is_found_whole(spark):
    rng = np.random.default_rng(2)
    center = rng.normal(size=32)
    rows = [(i, [float(x) for x in center + rng.normal(size=32) * 0.1], 0) for i in range(400)]
    found = vector_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), spark, Settings(shard=64)).collect()
    expected = {i: n for i, n, _ in plain_vectors(rows)}
    assert sum(r["n_links"] for r in found) >= 0.99 * sum(expected.values())
    assert all(r["n_links"] <= expected[r["vec_id"]] for r in found)


def test_links_across_shards_and_splits_of_splits(spark):
    """Strings of beads: each links with the next ones only, over many small shards."""
    rng = np.random.default_rng(4)
    rows = []
    for string in range(6):
        a, b = np.linalg.qr(rng.normal(size=(8, 2)))[0].T
        rows += [(len(rows) + k, [float(x) for x in np.cos(k / 12) * a + np.sin(k / 12) * b], 0) for k in range(70)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    settings_ = Settings(shard=8, fanout=6, audit=4, recall=0.0)
    found = vector_dedup.near_duplicates(table, spark, settings_).collect()
    expected = {i: (n, c) for i, n, c in plain_vectors(rows)}
    assert all(r["n_links"] <= expected[r["vec_id"]][0] for r in found)
    assert sum(r["n_links"] for r in found) >= 0.97 * sum(n for n, _ in expected.values())
    scratch = _shared.Scratch(spark, "test")
    nodes = scratch.keep(vector_dedup.distinct_vectors(table).withColumn("node", F.monotonically_increasing_id()), "nodes")
    shards = vector_dedup._shards(nodes, settings_, scratch)
    assert shards.select("shard").distinct().count() > 30 and shards.select("node").distinct().count() == len(rows)


def test_a_missed_recall_ends_in_the_exact_way(spark):
    rows = [(i, v, label) for i, v, label in vectors(np.random.default_rng(3)) if i is not None and i < 240]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    found = vector_dedup.near_duplicates(table, spark, Settings(shard=16, degree=1, beam=1, slack=0.0, recall=1.0)).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in found) == sorted(plain_vectors(rows))


def test_robust_prune_keeps_spread_neighbours():
    angles = np.array([0.0, 0.1, 0.11, 0.12, -0.2])
    x = np.stack([np.cos(angles), np.sin(angles)], axis=1).astype(np.float32)
    kept = vector_dedup.robust_prune(x, np.array([0]), np.array([[1, 2, 3, 4, -1]]), 4, 1.2)[0]
    assert kept[kept >= 0].tolist() == [1, 4]


# --- 3 packing ----------------------------------------------------------------------------------


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 9), min_size=1, max_size=8), st.integers(1, 5))
def test_boundaries_are_optimal(histogram, buckets):
    from itertools import combinations

    lengths = sorted(histogram)

    def padding(tops):
        return sum(n * (min(t for t in tops if t >= length) - length) for length, n in histogram.items())

    found = packing.boundaries(np.array(lengths), np.array([histogram[x] for x in lengths]), buckets)
    k = min(buckets, len(lengths))
    assert len(found) == k and padding(found) == min(padding([*c, lengths[-1]]) for c in combinations(lengths[:-1], k - 1))


def run_sql(sql, docs):
    con = duckdb.connect()
    con.register("documents", docs)
    return con.execute(sql)


def frame(rows):
    return pd.DataFrame({"doc_id": pd.array([r[0] for r in rows], "Int64"), "text": [r[1] for r in rows], "source": [r[3] for r in rows]})


def test_packing_equals_sql_and_keeps_every_token(spark, docs, empty):
    found = packing.pack(docs, spark)
    names = ["doc_id", "piece", "length", "bucket", "boundary", "batch"]
    expected = run_sql(f"select {', '.join(names)} from ({queries.packing_sql()})", frame(documents())).fetchall()
    assert rows_of(found, *names) == sorted(expected, key=repr)
    assert sum(r["length"] for r in found.collect()) == sum(len(words(t)) for _, t, _, _ in documents())
    fill = defaultdict(int)
    for r in found.filter("length > 0").collect():
        assert r["length"] <= r["boundary"]
        fill[r["bucket"], r["batch"]] += r["boundary"]
    assert max(fill.values()) <= packing.BUDGET
    assert packing.pack(empty, spark).count() == 0


# --- 4 token counts --------------------------------------------------------------------------------


def test_suffix_table_truncation_and_quantiles(spark, docs, empty):
    with open(token_counts.RANKS, "rb") as f:
        lengths = token_counts.count_tokens([t for _, t, _, _ in documents()], f.read()).tolist()
    table = token_counts.suffix_table(token_counts.length_histogram(docs, token_counts.token_count(F.col("text"), spark)), spark).cache()
    for r in table.collect():
        n = r["n_tokens"]
        assert r["n_docs"] == lengths.count(n)
        assert (r["docs_to"], r["tokens_to"]) == (sum(x <= n for x in lengths), sum(x for x in lengths if x <= n))
        assert (r["docs_longer"], r["tokens_longer"]) == (sum(x > n for x in lengths), sum(x for x in lengths if x > n))
        assert r["truncated_total"] == sum(min(x, n) for x in lengths)
    limits = [0, 1, 2, 7, 33, 100, 10**6]
    found = token_counts.truncated_totals(table, spark.createDataFrame([(x,) for x in limits], "limit long"))
    assert {r["limit"]: r["truncated_total"] for r in found.collect()} == {x: sum(min(v, x) for v in lengths) for x in limits}
    shares = [0.1, 0.5, 0.9, 1.0]
    expected = {q: sorted(lengths)[int(np.ceil(q * len(lengths) - 1e-9)) - 1] for q in shares}
    assert {r["share"]: r["n_tokens"] for r in token_counts.quantiles(table, shares).collect()} == expected
    assert token_counts.suffix_table(token_counts.length_histogram(empty, token_counts.token_count(F.col("text"), spark)), spark).count() == 0


def test_huge_texts_count_like_small_ones(spark):
    with open(token_counts.RANKS, "rb") as f:
        ranks = f.read()
    text = ("don't   stop 123 é日本 -- " * 3 + "\n\n") * 7000
    encoder = token_counts._encoder(ranks, token_counts.PATTERN)
    assert len(text) > 500_000 and token_counts.count_tokens([text], ranks)[0] == len(encoder.encode_ordinary(text))
    assert token_counts.count_tokens([None, "", "<|endoftext|>"], ranks).tolist()[:2] == [0, 0]
    with pytest.raises(FileNotFoundError, match="tallyweave.tokenizer.ranks"):
        token_counts.token_count(F.col("text"), spark, "/nowhere")


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=12), st.sampled_from([" ", "  ", "\n", " \t ", "don't", " we'll", "'S", "\x1c", "\x85", "\u00a0", "\u2003", "é", "漢字", "१२", "½", "🙂", "\u0301", " a", "1 "])), max_size=25).map("".join), st.integers(1, 40))
def test_stretches_and_the_other_splitter_count_the_same(text, length):
    with open(token_counts.RANKS, "rb") as f:
        ranks = f.read()
    whole = len(token_counts._encoder(ranks, token_counts.PATTERN).encode_ordinary(text))
    assert token_counts.count_tokens([text], ranks, length=length).tolist() == [whole]
    assert token_counts.count_tokens([text], ranks, whole=-1).tolist() == [whole]
    assert "".join(token_counts.stretches(text, length)) == text


# --- 5 language ------------------------------------------------------------------------------------


def test_codewords_lie_far_apart():
    for n in range(2, 13):
        code = language_id.codewords(n)
        apart = min((code[i] != code[j]).sum() for i in range(n) for j in range(i))
        assert apart >= (2 ** (n - 2) if n <= 7 else 6)
        assert (np.abs(code.sum(axis=0)) < n).all()


def test_language_prediction(spark, docs, empty):
    model = language_id.train_on(docs)
    assert model.languages == ["en", "es"]
    found = {r["doc_id"]: r["p"] for r in docs.select("doc_id", language_id.prediction(F.col("text"), model).alias("p")).collect()}
    assert all(found[i]["lang_pred"] == "und" and found[i]["score"] == 0 for i in (1, 2, 3))
    truth = {i: lang for i, _, lang, _ in documents() if i and i >= 100}
    assert np.mean([found[i]["lang_pred"] == truth[i] for i in truth]) > 0.95
    assert all(0 <= p["score"] <= 1 for p in found.values())
    ids = [r for r in range(3000)]
    held = spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", language_id.held_out(F.col("doc_id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in held)
    untrained = language_id.train_on(empty)
    assert untrained.predict("hello")[0] == "und" and empty.select(language_id.prediction(F.col("text"), untrained)).count() == 0
    assert language_id.train(docs.filter("lang = 'en'")).predict("hello")[:2] == ("en", 1.0)


def test_mixed_texts_are_ambiguous(spark):
    rng = random.Random(9)
    rows = [(i, prose(rng, 40, WORDS if i % 2 else SPANISH), "en" if i % 2 else "es") for i in range(400)]
    model = language_id.train_on(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    mixed = [" ".join(x for pair in zip(rng.choices(WORDS, k=60), rng.choices(SPANISH, k=60)) for x in pair) for _ in range(40)]
    found = [model.predict(t) for t in mixed]
    assert sum(f[3] for f in found) >= 10 and all(f[2] and f[1] - (1 - f[1]) < language_id.LEAD for f in found if f[3])
    assert not any(model.predict(t)[3] for _, t, _ in rows[:60])


def test_too_many_languages_are_refused(spark):
    rows = [(i, "some words", f"label {i}") for i in range(language_id.LANGUAGES + 9)]
    with pytest.raises(ValueError, match="different values of lang"):
        language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_language_query(spark, tmp_path):
    """The query's columns, and its accuracy on held-out rows, without a look at lang."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    found = {r["doc_id"]: r for r in queries.op5_language_id(spark, str(tmp_path)).collect()}
    rows = docs.collect()
    assert len(found) == len(rows)
    for r in rows:
        assert found[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert (found[r["doc_id"]]["lang_pred"] == "und") == (not re.search(r"[^\W\d_]", r["text"] or ""))
    model = language_id.train(docs.filter("crc32(cast(cast(doc_id as string) as binary)) % 4 <> 2"))
    assert all(model.predict(r["text"])[:2] == (found[r["doc_id"]]["lang_pred"], found[r["doc_id"]]["score"]) for r in rows)


def test_language_accuracy_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = docs.filter(language_id.held_out(F.col("doc_id"))).select("lang", language_id.prediction(F.col("text"), language_id.train_on(docs))["lang_pred"].alias("p"))
    assert found.filter("lang = p").count() >= 0.97 * found.count()


# --- 6 conversations ----------------------------------------------------------------------------------


def conversations():
    rng = random.Random(6)
    whole = [[(k % 2 and "assistant" or "user", prose(rng, 3)) for k in range(n)] for n in (4, 600, 5)]
    logs = [whole[0], whole[0][:1], whole[0][:3], whole[1], whole[1][:300], whole[2], whole[2], whole[2][:2] + [("user", "other")], [("user", None)], [("user", "")], [(None, "x")], [("user", "ab"), ("c", "d")], [("user", "a"), ("bc", "d")]]
    rows = [(i, t, role, text) for i, turns in enumerate(logs) for t, (role, text) in enumerate(turns)]
    rows += [(i, t + 5, role, text) for i, turns in [(50, whole[0][:2])] for t, (role, text) in enumerate(turns)]
    return rows + [(None, 0, "user", "lost"), (60, None, "user", "no turn"), (60, None, "user", "no turn"), (61, 1, "user", "tie"), (61, 1, "user", "tie2")]


def test_maximal_conversations_equal_brute_force_and_sql(spark):
    rows = conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("place", F.lit(9)).withColumn("h1", F.lit("x"))
    logs = defaultdict(list)
    for c, t, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], *((x is not None, x if x is not None else 0 if n == 0 else "") for n, x in enumerate(r[1:])))):
        logs[c].append((role, text))
    kept = {c for c, turns in logs.items() if not any(other[: len(turns)] == turns and (len(other) > len(turns) or d < c) for d, other in logs.items() if d != c)}
    found = chat_format.maximal_conversations(df, spark).collect()
    assert {r["conv_id"] for r in found} == kept
    shown = defaultdict(str)
    for r in sorted(found, key=lambda r: (r["conv_id"], r["part"])):
        shown[r["conv_id"]] += r["rendered"]
        assert r["n_turns"] == len(logs[r["conv_id"]])
    assert shown == {c: "".join(f"<|im_start|>{role or ''}\n{text or ''}<|im_end|>\n" for role, text in logs[c]) for c in kept}
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    expected = con.execute(f"select conv_id, n_turns, part, rendered from ({queries.CHAT_SQL})").fetchall()
    assert sorted((r["conv_id"], r["n_turns"], r["part"], r["rendered"]) for r in found) == sorted(expected)
    assert chat_format.maximal_conversations(df.limit(0), spark).count() == 0


# --- 7 mixing --------------------------------------------------------------------------------------------


def plain_targets(sizes, share=1.5):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(sizes), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        for s in full or open_:
            out[s] = 2 * sizes[s] if full else level * weight[s]
            left -= out[s] if full else 0
        open_ -= full or open_
    return out


def test_mix_targets_and_words(spark, docs, empty):
    sizes = Counter()
    for _, text, _, source in documents():
        sizes[source] += len(words(text))
    target = plain_targets(sizes)
    found = mixing.fair_mix(docs, spark).collect()
    assert len(found) == len(documents())
    expected = run_sql(f"select doc_id, size, source_size, target, taken, first_end from ({queries.MIX_SQL})", frame(documents())).fetchall()
    got = [(r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"], r["first_end"]) for r in found]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in found)
    taken = Counter()
    for r in found:
        taken[r["source_size"], round(r["target"], 6)] += r["taken"]
    for s, t in target.items():
        assert abs(taken[sizes[s], round(t, 6)] - sum(x for q, x in target.items() if (sizes[q], round(x, 6)) == (sizes[s], round(t, 6)))) < 3
    again = mixing.fair_mix(docs.repartition(7), spark)
    assert rows_of(again, "doc_id", "size", "taken", "first_end") == rows_of(mixing.fair_mix(docs, spark), "doc_id", "size", "taken", "first_end")
    assert mixing.fair_mix(empty, spark).count() == 0
    assert mixing.fair_mix(docs.filter("doc_id < 4"), spark).agg(F.sum("taken")).first()[0] == 0


def test_mixed_documents_are_whole_and_near_their_targets(spark, docs, empty):
    out = mixing.mixed_documents(docs, spark)
    assert out.columns == docs.columns
    texts = {(i, t) for i, t, _, _ in documents()}
    used, rows = Counter(), out.collect()
    assert all((r["doc_id"], r["text"]) in texts for r in rows)
    for r in rows:
        used[r["source"]] += len(words(r["text"]))
    sizes, longest = Counter(), Counter()
    for _, text, _, source in documents():
        sizes[source] += len(words(text))
        longest[source] = max(longest[source], 2 * len(words(text)))
    for s, t in plain_targets(sizes).items():
        assert t - 1 <= used[s] <= t + longest[s]
    assert mixing.mixed_documents(empty, spark).count() == 0


def test_mixed_documents_hold_the_budget_of_many_small_sources(spark):
    for n in (60, 61):
        docs = spark.createDataFrame([(i, f"w{i} " + "w " * 99, f"s{i:03d}") for i in range(n)], "doc_id long, text string, source string")
        used = mixing.mixed_documents(docs, spark).count() * 100
        assert 150 * n <= used < 150 * n + 100
    # A use out of the plain queue: whole documents by finish time, until the targets together are reached.
    rng = random.Random(3)
    rows = [(i if i % 7 else 5, f"w{i} " + "w " * rng.choice([0, 3, 40, 900]), rng.choice(["a", "b", None, "c", "d"])) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    ties = {r["text"]: tuple(r["ties"]) for r in docs.select("text", F.array(*_shared.row_marks(docs)).alias("ties")).collect()}
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(words(text))
    targets, uses = plain_targets(sizes), []
    for s, target in targets.items():
        at = 0
        for epoch in range(2):
            for order, i, tie, text in sorted((hashlib.md5(str(i).encode()).hexdigest(), i, ties[text], text) for i, text, source in rows if source == s):
                at += len(words(text))
                uses.append((at / target, s or "", s is None, epoch, order, i, tie, text))
    expected, ahead = Counter(), 0
    for use in sorted(uses):
        if ahead < round(sum(targets.values()), 3):
            expected[use[-1]] += 1
        ahead += len(words(use[-1]))
    assert Counter(r["text"] for r in mixing.mixed_documents(docs, spark).collect()) == expected


def test_mixed_documents_hold_the_budget_of_repeated_rows(spark):
    """Equal rows are used as often as the cut says: 150 words share 225 of budget."""
    for rows, least, most in (([(1, "w " * 50, "s")] * 3, 225, 274), ([(None, "w " * 10, "s")] * 40, 600, 609), ([(None, f"w{i % 3} " * 10, None) for i in range(40)], 600, 609)):
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
        used = sum(len(words(r["text"])) for r in mixing.mixed_documents(docs, spark).collect())
        assert least <= used <= most


def test_targets_of_many_sources(spark):
    rng = random.Random(6)
    sizes = {f"s{i:04d}" if i else None: rng.randrange(400) for i in range(900)}
    table = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    found = {r["source"]: r["target"] for r in mixing.source_targets(table, _shared.Scratch(spark, "test")).collect()}
    assert found == pytest.approx(plain_targets(sizes))


# --- 8 personal data ----------------------------------------------------------------------------------------

_PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_personal(text):
    out = []
    for kind, pattern in _PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            check = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits[::-1])) % 10 == 0
            if (kind == "email") or (kind == "ip" and all(int(p) <= 255 for p in m[0].split("."))) or (kind == "card" and 14 <= len(digits) <= 19 and check) or (kind == "phone" and 10 <= len(digits) <= 15):
                out.append((kind, m.start(), m.end()))
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "b.c", "@", ".", "-", " ", "+", "1", "25", "255", "256", "4111 1111 1111 1111", "(", ")", "é", "\n", "x@y.z", "1.2.3.4", "٣", "+1 269 555 3296", "%", "00"]), max_size=14))
def test_base_personal_data_is_that_of_the_patterns(parts):
    text = "".join(parts)
    assert sorted(pii.base_spans(text)) == plain_personal(text)


def test_patterns_are_fast_on_long_runs():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1" + " " * 300_000, "a@" * 150_000, "a@b." * 60_000):
        pii.base_spans(text)


def test_crf_learns_its_table_and_decodes_like_a_search():
    model = pii.ChainCrf(pii.labelled_table(4))
    other = pii.labelled_table(1, seed=123)
    right = total = 0
    for _, g in other.groupby("sentence"):
        labels = model.decode([g["token"].tolist()])[0]
        right += sum(pii.LABELS[b] == a for a, b in zip(g["label"], labels, strict=True))
        total += len(g)
    assert right / total > 0.97
    rng = np.random.default_rng(1)
    scores, n = rng.normal(size=(3, 4, model.k)), np.array([4, 2, 1])
    found = model.viterbi(scores, n)
    from itertools import product

    for row in range(3):
        best = max(product(range(model.k), repeat=n[row]), key=lambda p: sum(scores[row, t, p[t]] for t in range(n[row])) + sum(model.moves[a, b] for a, b in zip(p, p[1:])))
        assert tuple(found[row, : n[row]]) == best


def test_personal_query(spark, docs, empty):
    found = {r["doc_id"]: r["s"] for r in docs.select("doc_id", pii.personal_spans(F.col("text")).alias("s")).collect()}
    texts = {i: t for i, t, _, _ in documents()}
    for i, spans in found.items():
        assert sorted((s["kind"], s["start"], s["end"]) for s in spans if s["kind"] in pii.BASE) == plain_personal(texts[i] or "")
    assert not found[6] and not found[11] and {"email", "phone"} <= {s["kind"] for s in found[15]}
    finder = pii.Finder()
    clean = [prose(random.Random(i), 50) + " It was 1999, page 12, version 2.0." for i in range(20)]
    assert sum(map(len, finder.find_all(clean))) == 0
    assert any(k == "crf_id" for k, _, _ in finder.find_all(["her ssn 123-45-6789 was copied"])[0])
    assert empty.select(pii.personal_spans(F.col("text"))).count() == 0


def test_whole_lines_are_decoded(spark):
    finder = pii.Finder()
    for text, address in (("please write to jane at mailer dot com before noon", "jane at mailer dot com"), ("the and of\nwrite to jane at mailer dot com", "jane at mailer dot com"), ("page 12: contact jane at mailer dot com for details", "jane at mailer dot com")):
        assert [text[a:b] for k, a, b in finder.find_all([text])[0] if k == "crf_email"] == [address]
    row = spark.createDataFrame([("mail me at jane at mailer dot com, thanks",)], "text string").select(pii.without_personal(F.col("text"), finder=finder).alias("t"))
    assert "mailer" not in row.first()["t"]
    # The labels are those of the best path by the plain features, at any length and in any batch.
    model, rng = finder.model, random.Random(5)
    parts = ["x", "at", "dot", "(at)", "Jane", "com,", "a.b@c.org", "12", "1.2.3.4", "123-45-6789", "+1", "é²٣", "_", "...", "a" * 70 + "1", "card", "4111", "ssn", "wx_yz9"]
    lines = [[rng.choice(parts) for _ in range(rng.choice([1, 2, 3, 9, 40, 300]))] for _ in range(60)]
    for line, found in zip(lines, model.decode(lines, batch=500), strict=True):
        scores = np.stack([model.weights[[model.ids[f] for f in pii.features(line, i) if f in model.ids]].sum(axis=0) for i in range(len(line))])
        path = lambda labels: sum(scores[i, a] for i, a in enumerate(labels)) + sum(model.moves[a, b] for a, b in zip(labels, labels[1:]))
        best = scores[0]
        for x in scores[1:]:
            best = (best[:, None] + model.moves).max(axis=0) + x
        assert abs(path(found) - best.max()) < 1e-6


def test_personal_digest_columns(spark, tmp_path, docs):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.op8_personal_data(spark, str(tmp_path)).collect()
    texts = {i: t or "" for i, t, _, _ in documents()}
    finder = pii.Finder()
    assert Counter(r["doc_id"] for r in found) == Counter(i for i, _, _, _ in documents())
    for r in found:
        text = texts[r["doc_id"]]
        base = sorted(plain_personal(text), key=lambda x: (x[1], pii.BASE.index(x[0])))
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(x[0] == k for x in base) for k in pii.BASE]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert r["spans"] == ",".join(f"{k}:{a}:{b}" for k, a, b in finder.find_all([text])[0])


#: Lines written by hand, apart from the model's table; personal data stands in brackets.
MARKED = """
Hi team, my new mailbox is [email:martin.keller@posteo.example.org], the old one closes on Friday.
You'll find me as [email:k_owens77@uni-example.edu] from the autumn term on.
Kontakt: [email:info@beispiel-verein.de] oder [phone:+49 30 5550 1234], werktags bis 17 Uhr.
Drop a line to [email:sue at harborview dot org] and she'll add you to the list.
For returns write [email:returns (at) shopfront (dot) com] within 14 days.
Spam bots can't read [email:tom[at]rivermail.net], or so he believes.
He bought 3 tickets at 25 dollars each and left at 9.
The lecture is at ten, at the old chapel behind the dot matrix museum.
Emergency contact: Laura, [phone:(415) 555-0137], after hours [phone:415-555-0199].
My number hasn't changed: [phone:+44 20 7946 0958].
Text [phone:555.867.5309] to unsubscribe.
Ring the bell twice, then phone [phone:(020) 7946 0123] if nobody comes.
Call volume rose by 12% in 2019 and 14% in 2020.
Her Visa is [card:4539 1488 0343 6467] and it expires in March.
We refunded card [card:5425-2334-3010-9903] on 12/04/2021.
Amex [card:378282246310005] was declined twice.
Order 4539148803 shipped in 2 parcels, 4.5 kg in total.
The router answers at [ip:192.168.17.254] and the printer at [ip:10.0.4.31].
Blocked [ip:203.0.113.77] after 250 failed logins.
Upgrade to version 4.12.1 before 2023-06-30.
Section 3.2.1.4 of the manual covers this, see page 118.
Her social security number, [id:078-05-1120], was printed on the form.
SSN [id:219-09-9999] does not match our records.
Please pay into [id:DE44 5001 0517 5407 3249 31] by the end of May.
The IBAN is [id:GB29 6016 1331 9268 1937 29], reference 2291.
ISBN 978-0-306-40615-7, 312 pages, 24.90 EUR.
The score was 21-19, 18-21, 21-17.
Flight LH 454 leaves at 10:35 from gate B44.
Meet at 555 Main Street, room 1204, at 15:30.
It weighs 1.250 kg and costs $1,299.00.
From 1914 to 1918 about 65,000,000 men were mobilised.
@newsdesk posted 12 photos at noon.
Contact us at the front desk or by mail.
user: [email:p.moreau+lists@example.co.uk], last seen at [ip:172.16.254.1]
Fax [phone:+1 212-555-0175] still works, believe it or not.
cc [email:accounts@northwind.example.com]; [email:legal@northwind.example.com]
The dot at the end of line 12 is missing.
Chapter 7, verses 11-14, 3rd edition.
Population 8,336,817 at the 2020 census.
He ran 42.195 km in 3:05:12.
Billing desk, [phone:+61 2 5550 4411], open nine to five.
The parcel went to unit 7, 1420 Orchard Lane.
Send scans to [email:archive.desk@museum-friends.org] please.
Ping [ip:198.51.100.23] twice and tell me what you see.
My old card, [card:6011 0009 9013 9424], was cut in half.
Write me: [email:dora at fieldnote dot net].
Chrome 118.0.5993 fixed the bug on 10 October.
The tender closes on 31.12.2024 at 12:00.
[phone:(312) 555-0142] is the night line, [phone:312-555-0143] the day line.
She scored 99.5 out of 100 in all 14 rounds.
His national number [id:536-22-8841] leaked last spring.
Rent: 1 450 EUR, heating 120 EUR, deposit 2 900 EUR.
"""


def test_recall_and_precision_on_lines_written_by_hand():
    """Spans of a kind, found by the pattern or the model, that meet the marked ones."""
    marked, lines = [], []
    for line in MARKED.strip().split("\n"):
        text, spans, at = "", [], 0
        for m in re.finditer(r"\[(email|phone|card|ip|id):((?:\[at\]|[^\]])*)\]", line):
            text += line[at : m.start()]
            spans.append((m[1], len(text), len(text) + len(m[2])))
            text, at = text + m[2], m.end()
        lines.append(text + line[at:])
        marked.append(spans)
    true, hit, reported, right = Counter(), Counter(), Counter(), Counter()
    for spans, found in zip(marked, pii.Finder().find_all(lines), strict=True):
        meets = lambda x, y: x[0].removeprefix("crf_") == y[0] and x[1] < y[2] and y[1] < x[2]
        for s in spans:
            true[s[0]] += 1
            hit[s[0]] += any(meets(f, s) for f in found)
        for f in found:
            if f[0].startswith("crf_"):
                reported[f[0][4:]] += 1
                right[f[0][4:]] += any(meets(f, s) for s in spans)
    print({k: (f"recall {hit[k]}/{true[k]}", f"precision of the model {right[k]}/{reported[k]}") for k in true})
    assert sum(hit.values()) >= 0.85 * sum(true.values()) and sum(right.values()) >= 0.8 * sum(reported.values())
    assert all(hit[k] >= 0.6 * true[k] for k in true)


def test_long_lines_go_in_stretches(monkeypatch):
    finder, rng = pii.Finder(), random.Random(2)
    line = " ".join(rng.choice(["word", "12", "call", "555-123-4567", "jane at mailer dot com", "card 4111 1111 1111 1111"]) for _ in range(2000))
    whole = finder.find_all([line])[0]
    for stretch in (150, 333):
        monkeypatch.setattr(pii, "STRETCH", stretch)
        assert finder.find_all([line, "x", line]) == [whole, [], whole]


# --- 9 simhash ------------------------------------------------------------------------------------------------


def plain_simhash(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    w = [bytes(b + 32 if 65 <= b <= 90 else b for b in x) for x in w]
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_match_spark_and_brute_force(spark):
    for _, text, _, _ in documents():
        assert simhash.simhash(text) == plain_simhash(text)
    one = spark.createDataFrame([("Two É words",)], "t string").select(F.xxhash64(F.lit("two É words"))).first()[0]
    assert simhash.simhash("Two É words") == one % (1 << 64)


def test_simhash_query(spark, docs, empty):
    rows = documents()
    fps = [plain_simhash(t) for _, t, _, _ in rows]
    root = union_find(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if bin(fps[a] ^ fps[b]).count("1") <= 2])
    least = defaultdict(lambda: 1 << 60)
    for r, (i, _, _, _) in zip(root, rows):
        least[r] = min(least[r], i if i is not None else 1 << 60)
    found = simhash.near_duplicates(docs, spark).select("doc_id", simhash.hex_digits(F.col("fp")).alias("f"), "component_id")
    assert rows_of(found, "doc_id", "f", "component_id") == sorted(((i, f"{f:016x}", least[r]) for (i, _, _, _), f, r in zip(rows, fps, root)), key=repr)
    assert simhash.near_duplicates(empty, spark).count() == 0
    kept = simhash.keep_one(docs, spark)
    assert kept.columns == docs.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids == Counter({i: 1 for r, (i, _, _, _) in zip(root, rows) if i is not None and least[r] == i})
    assert simhash.keep_one(empty, spark).count() == 0


def test_one_of_each_group_stays_whatever_the_ids(spark):
    """Ids that repeat, or are null, on unrelated texts; rows equal in all columns."""
    rng = random.Random(8)
    a, b, c, d = (prose(rng, 60, [x + w for w in WORDS]) for x in "abcd")
    rows = [(3, a, "x"), (7, a, "x"), (7, b, "x"), (9, c, "x"), (9, b + " ", "x"), (None, d, None), (None, d, "x"), (None, c.upper(), "x")]
    rows += [(1, prose(rng, 50), "x")] * 40 + [(None, prose(rng, 45), "x")] * 5 + [(2, "", "x"), (2, None, None), (2, None, "x")]
    made = spark.createDataFrame(rows, "doc_id long, text string, _word string").repartition(7)
    marks = [plain_simhash(t) for _, t, _ in rows]
    root = union_find(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if bin(marks[i] ^ marks[j]).count("1") <= 2])
    least = {}
    for r, (i, _, _) in zip(root, rows):
        least[r] = min(least.get(r, 1 << 60), 1 << 60 if i is None else i)
    kept = simhash.keep_one(made, spark).collect()
    assert len(kept) == len(least)
    group = {t: r for r, (_, t, _) in zip(root, rows)}
    assert {group[r["text"]]: 1 << 60 if r["doc_id"] is None else r["doc_id"] for r in kept} == least
    again = simhash.keep_one(made.repartition(3), spark).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, kept))


def test_word_filter_loses_no_key(spark):
    keys = spark.range(3000).select(F.xxhash64("id").alias("a"), F.xxhash64("id", F.lit(1)).alias("b"))
    every = spark.range(40_000).select(F.xxhash64("id").alias("a"), F.xxhash64("id", F.lit(1)).alias("b"), "id")
    out, kept = _shared.WordFilter(keys, "a", "b").split(every)
    assert out.count() + kept.count() == 40_000 and out.filter("id < 3000").isEmpty() and kept.count() < 3100


@pytest.mark.parametrize("long_list,groups", [(64, 8), (2, 3), (1, 1)])
@pytest.mark.parametrize("distance", [0, 1, 2])
def test_links_equal_brute_force(spark, long_list, groups, distance):
    rng = random.Random(long_list * 10 + distance)
    values = set()
    for _ in range(12):
        center = rng.getrandbits(64)
        values |= {center ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))) for _ in range(12)}
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    expected = union_find(len(values), [(a, b) for a in range(len(values)) for b in range(a) if bin(values[a] ^ values[b]).count("1") <= distance])
    found = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), _shared.Scratch(spark, "test"), distance, long_list, groups).collect()
    place = {v: i for i, v in enumerate(signed)}
    assert all(expected[place[r["a"]]] == expected[place[r["b"]]] for r in found)
    assert union_find(len(values), [(place[r["a"]], place[r["b"]]) for r in found]) == expected


def test_links_of_many_near_copies(spark):
    """Lists far beyond the direct comparison, one of them full in both open bytes."""
    rng = random.Random(3)
    center = rng.getrandbits(62)
    values = {center ^ x for x in range(1 << 12)} | {center ^ x << 40 for x in range(1 << 9)} | {center ^ sum(1 << b for b in rng.sample(range(62), 5)) for _ in range(60)}
    values = sorted(values)
    place = {v: i for i, v in enumerate(values)}
    near = [(i, place[w]) for v, i in place.items() for a in range(62) for b in range(a + 1) if (w := v ^ (1 << a | 1 << b)) in place]
    found = simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"), _shared.Scratch(spark, "test")).collect()
    assert union_find(len(values), [(place[r["a"]], place[r["b"]]) for r in found]) == union_find(len(values), near)


# --- 10 media ----------------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=9000))
def test_containers_give_back_their_payload(data):
    payload = media.padded(data)
    assert len(payload) % 64 == 0 and len(payload) >= 64 and payload[: len(data)] == data and not any(payload[len(data) :])
    stored = media.container(payload)
    (track,) = media.index(stored)
    frames = len(payload) // 64
    assert media.payload(stored, track) == payload and (track.codec, track.duration, len(track.sizes)) == ("raw ", frames, frames)
    assert [stored[a:b] for a, b in track.key_ranges().tolist()] == [payload[i * 64 : i * 64 + 64] for i in range(0, frames, media.GROUP)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3000), st.integers(0, 255)), max_size=6), st.integers(0, 3000))
def test_broken_files_give_an_error_not_a_crash(changes, cut):
    data = bytearray(media.container(media.padded(b"x" * 1000)))
    for at, value in changes:
        data[at % len(data)] = value
    media.read(bytes(data))
    media.read(bytes(data[:cut]))


_LEAVES = [b"mdhd", b"tkhd", b"hdlr", b"stsd", b"stts", b"stsc", b"stss", b"stsz", b"stz2", b"stco", b"co64", b"trex", b"tfhd", b"trun", b"free"]
_FIELDS = st.lists(st.sampled_from([0, 1, 2, 3, 7, 64, 1 << 16, 0x01000000, 0x305, 0x7FFFFFFF, 0xFFFFFFFF]), max_size=9).map(lambda x: struct.pack(f">{len(x)}I", *x))
_TREES = st.recursive(
    st.tuples(st.sampled_from(_LEAVES), _FIELDS),
    lambda inner: st.tuples(st.sampled_from(sorted(media.NESTED)), st.lists(inner, max_size=5)),
    max_leaves=25,
)


def boxed(tree):
    kind, body = tree
    return media._box(kind, body if isinstance(body, bytes) else b"".join(map(boxed, body)))


@settings(max_examples=600, deadline=None)
@given(st.lists(_TREES, max_size=4))
def test_any_tree_of_boxes_is_read_or_named_malformed(trees):
    data = b"".join(map(boxed, trees))
    tracks, row = media.read(data)
    assert ("error" in row) != ("tracks" in row)
    for t in tracks:
        media._stored(data, [t], 0)
    pa.array([row], media._INDEX)


def test_faults_that_once_ended_the_job(spark):
    unknown = media._box(b"trak", media._box(b"mdia", media._full(b"mdhd", struct.pack(">QQIQ", 0, 0, 30, (1 << 64) - 1), version=1)))
    stray = media._full(b"tfhd", struct.pack(">I", 1))
    deep = b""
    for _ in range(3000):
        deep = media._box(b"udta", deep)
    bomb = media._box(b"moof", media._box(b"traf", media._full(b"tfhd", struct.pack(">I", 1)) + media._full(b"trun", struct.pack(">I", 900)) * 50))
    rows = [unknown, stray, deep, bomb, b"no", b"", None]
    made = spark.createDataFrame([(None if x is None else bytearray(x),) for x in rows], "b binary")
    found = made.select(media.media_index(F.col("b")).alias("i"), media.stored_payload(F.col("b")).alias("p")).collect()
    assert found[0]["i"]["tracks"][0]["duration"] is None and found[0]["i"]["tracks"][0]["timescale"] == 30
    assert all(r["i"]["error"] and r["i"]["tracks"] is None and r["p"] is None for r in found[1:5])
    assert found[5]["i"]["tracks"] == [] and found[6]["i"] is None and found[6]["p"] is None


def test_all_tracks_are_indexed():
    one = media.container(media.padded(b"a" * 100))
    moov = next(one[at:end] for kind, at, _, end in media.boxes(one) if kind == b"moov")
    second = moov.replace(b"vide", b"soun").replace(struct.pack(">IIIII", 0, 0, 1, 0, 2), struct.pack(">IIIII", 0, 0, 2, 0, 2))
    assert [(t["track_id"], t["handler"]) for t in media.read(one + second)[1]["tracks"]] == [(1, "vide"), (2, "soun")]


def plain_boxes(data):
    """A reader written apart: {path: [bodies]} of all boxes."""
    out, todo = defaultdict(list), [("", data)]
    while todo:
        path, rest = todo.pop()
        while rest:
            size, kind = int.from_bytes(rest[:4], "big"), rest[4:8].decode("latin-1")
            body = rest[8:size]
            out[f"{path}/{kind}"].append(body)
            if kind in ("moov", "trak", "mdia", "minf", "stbl", "dinf"):
                todo.append((f"{path}/{kind}", body))
            rest = rest[size:]
    return out


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=9000))
def test_containers_are_read_by_another_reader(data):
    payload = media.padded(data)
    stored = media.container(payload)
    found = plain_boxes(stored)
    u4 = lambda body, at=0: [int.from_bytes(body[i : i + 4], "big") for i in range(at, len(body) - 3, 4)]
    table = {kind: u4(found[f"/moov/trak/mdia/minf/stbl/{kind}"][0]) for kind in ("stsz", "stsc", "stco", "stss", "stts")}
    _, size, n = table["stsz"]
    runs = [tuple(table["stsc"][i : i + 3]) for i in range(2, len(table["stsc"]), 3)]
    read, left = b"", n
    for number, offset in enumerate(table["stco"][2:], 1):
        per = [r[1] for r in runs if r[0] <= number][-1]
        read += stored[offset : offset + size * per]
        left -= per
    assert left == 0 and read == payload == found["/mdat"][0]
    assert table["stts"][1:] == [1, n, 1] and table["stss"][2:] == list(range(1, n + 1, media.GROUP))
    assert u4(found["/moov/trak/mdia/mdhd"][0])[3:5] == [30, n] and found["/moov/trak/mdia/minf/stbl/stsd"][0][12:16] == b"raw "
    assert found["/ftyp"][0][:4] == b"isom" and found["/moov/trak/mdia/hdlr"][0][8:12] == b"vide"


def test_fragmented_files():
    box = media._box
    moov = box(b"moov", box(b"trak", media._full(b"tkhd", struct.pack(">IIIII", 0, 0, 7, 0, 0)), box(b"mdia", media._full(b"mdhd", struct.pack(">IIII", 0, 0, 1000, 0)))), box(b"mvex", media._full(b"trex", struct.pack(">IIIII", 7, 1, 40, 5, 1 << 16))))
    trun = media._full(b"trun", struct.pack(">IiI", 3, 100, 0), struct.pack(">III", 5, 6, 7), flags=0x205)
    moof = box(b"moof", box(b"traf", media._full(b"tfhd", struct.pack(">I", 7)), trun))
    (track,) = media.index(moov + moof + box(b"mdat", bytes(40)))
    start = len(moov) + 100
    assert track.offsets.tolist() == [start, start + 5, start + 11] and track.sizes.tolist() == [5, 6, 7]
    assert track.keyframes.tolist() == [0] and track.duration == 120


def test_media_query(spark, tmp_path, docs, empty):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    found = {(r["doc_id"], r["n_bytes"]): r for r in queries.op10_media_index(spark, str(tmp_path)).collect()}
    for i, text, _, _ in documents():
        data = (text or "").encode()
        payload = data + bytes(-len(data) % 64 or (0 if data else 64))
        r = found[i, len(data)]
        assert (r["payload_bytes"], r["payload_sha256"]) == (len(payload), hashlib.sha256(payload).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(payload[-64:])
        stored = media.container(payload)
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert r["feature"].startswith(f"codec=raw;timescale=30;duration={len(payload) // 64};")
    empty.write.parquet(str(tmp_path / "none/documents.parquet"))
    assert queries.op10_media_index(spark, str(tmp_path / "none")).count() == 0
