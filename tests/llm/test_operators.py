"""The llm operators on small tables: brute force, round trips, and the cases that docstrings define."""

import base64
import hashlib
import os
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ferrule.llm import bpe, common, embedding_dedup, jaccard_join, language_id, line_dedup, mixing, pii, quality_rules, registry, substring_dedup, warc

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, kept string"
ODD = [(1, None, None, None, "x"), (2, "", "en", "a", None), (2, "", "en", "a", None), (None, " \t\n", "de", "b", ""), (3, "word " * 30_000, "en", "a", ""), (4, "word " * 30_000, None, None, ""), (5, "one two", "fr", "b", "")]


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    got, want = registry.QUERIES[name](spark, SF).toPandas(), con.sql(registry.ORACLE_SQL[name]).df()
    cols = sorted(want.columns)
    assert set(cols) <= set(got.columns)
    assert sorted(map(str, got[cols].values.tolist())) == sorted(map(str, want[cols].values.tolist()))


RUNS = {
    "quality": lambda d: quality_rules.quality_rules(d),
    "lines": lambda d: line_dedup.line_dedup(d),
    "language": lambda d: language_id.language_id(d, language_id.fit(d)),
    "pii": lambda d: pii.find_pii(d),
    "jaccard": lambda d: jaccard_join.jaccard_components(d),
    "mix": lambda d: mixing.mix(d),
    "substring": lambda d: substring_dedup.substring_dedup(d),
}


@pytest.mark.parametrize("name", sorted(RUNS))
def test_odd_rows_and_empty_tables(spark, name):
    docs = spark.createDataFrame(ODD, DOC)
    assert len(RUNS[name](docs).collect()) == len(ODD)
    assert RUNS[name](docs.limit(0)).collect() == []


def test_substring_removes_repeats_only(spark):
    shared = " ".join(f"s{i}" for i in range(35))
    got = {r["doc_id"]: r for r in substring_dedup.substring_dedup(spark.createDataFrame([(1, f"a b {shared} c"), (2, f"{shared}\nd"), (3, shared[:-3])], "doc_id long, text string")).collect()}
    assert got[1]["kept_text"] == "a b c" and got[2]["kept_text"] == "d" and got[3]["n_removed"] == 0


def test_jaccard_brute_force(spark):
    rnd, rows = random.Random(5), []
    for g in range(4):
        base = [f"w{rnd.randrange(300)}" for _ in range((30, 80, 250, 600)[g])]
        for _ in range(25):
            w = list(base)
            for _ in range(rnd.randrange(1 + len(w) // 40)):
                w[rnd.randrange(len(w))] = f"x{rnd.randrange(999)}"
            rows.append((len(rows), " ".join(w)))
    sets = {i: {tuple(t.split()[k : k + 4]) for k in range(len(t.split()) - 3)} for i, t in rows}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    want = {(i, len(s), root(i)) for i, s in sets.items()}
    for rare, bits in ((3, 64), (12, 12)):  # with addresses of 12 bits classes clash
        got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), rare_df=rare, chunk_bytes=20_000, address_bits=bits)
        assert set(map(tuple, got.collect())) == want


def test_components_of_shuffled_path(spark):
    for ids in (np.random.default_rng(1).permutation(1500),):
        edges = list(zip(ids[:-1].tolist(), ids[1:].tolist(), strict=True)) + [(5001, 5000), (5001, 5001)]
        with common.Scratch(spark) as s:
            got = {r["node"]: r["component"] for r in common.components(s, spark.createDataFrame(edges, "a long, b long")).collect()}
            half = common.components(s, spark.createDataFrame(edges[::2], "a long, b long"))
            both = {r["node"]: r["component"] for r in common.merged(s, half, spark.createDataFrame(edges[1::2], "a long, b long")).collect()}
        assert got == both == {**dict.fromkeys(range(1500), 0), 5000: 5000, 5001: 5000}
    with common.Scratch(spark) as s, pytest.raises(RuntimeError):
        common.components(s, spark.createDataFrame(edges, "a long, b long"), rounds=2)


def test_scratch_tables_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "scratch_dir", lambda _: f"file://{tmp_path}")

    def swept(want):
        """What a sweep deletes in the end; the JVM learns a little later of what Python lets go of."""
        for _ in range(20):
            common.Scratch.sweep(spark)
            spark.range(1).count()
            held = [x.split("-")[0] for x in os.listdir(tmp_path)]
            if held == want:
                break
        return held

    with common.Scratch(spark) as s:
        kept, gone = s.table(spark.range(5), "kept"), s.table(spark.range(6), "gone")
        out = s.result(kept.where("id > 1").join(spark.range(9), "id"))
        assert gone.count() == 6
    del gone, kept, s
    assert swept(["kept"]) == ["kept"] and out.count() == 3
    with pytest.raises(ZeroDivisionError), common.Scratch(spark) as s:
        s.table(spark.range(5), "lost")
        raise ZeroDivisionError
    assert swept(["kept"]) == ["kept"]
    del out, s
    assert swept([]) == []


def test_lines_keep_first_copy(spark):
    a, b = "a b c d e f g h i j k", "l m n o p q r s t u v"
    rows = [(1, f"{a}\nx\n{b}"), (2, f"new\n{a}\nx\n{b}\nx"), (3, f"{b}\n{a}"), (4, "x")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "new\nx", 3: b, 4: "x"}


def test_lines_align_with_real_partners(spark):
    a, b, d = ("a b c d e f g h i j k", "l m n o p q r s t u v", "1 2 3 4 5 6 7 8 9 10 11")
    rows = [(1, f"{a}\n{b}"), (2, f"{b}\n{a}\n{d}"), (3, f"{b}\n{a}\n{d}"), (4, f"{b}\n{a}\nnew\n{d}")]
    rows += [(10 + i, f"{a}\nq{i}\n{b}") for i in range(5)]
    for rare in (2, 64):
        got = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), rare_df=rare).collect()}
        assert got[1] == rows[0][1] and got[3] == "" and got[4] == "new"
        assert [got[10 + i] for i in range(5)] == [f"q{i}" for i in range(5)]


def test_lines_empty_short_copies(spark):
    texts = [" ".join(f"w{n}x{k}" for k in range(n)) for n in range(1, 10)]
    rows = [(i, t) for i, t in enumerate(texts)] * 2 + [(20, "p\n\n q"), (21, " p\nq"), (22, "p q"), (None, "p q"), (23, "p")]
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for i, t in enumerate(texts):
        assert sorted((r["text"], r["n_removed"], r["n_words_left"]) for r in got if r["doc_id"] == i) == [("", 1, 0), (t, 0, i + 1)]
    left = {r["doc_id"]: (r["text"], r["n_words_left"]) for r in got}
    assert left[20] == ("p\n\n q", 2) and left[21] == ("", 0) and left[22] == ("p q", 2) and left[None] == ("", 0) and left[23] == ("p", 1)


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language_id.language_id(docs, language_id.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").where(language_id.held_out(F.col("doc_id"))).toPandas()
    assert (out.lang == out.lang_pred).mean() > 0.97


@pytest.mark.parametrize("leaf", [1, 3, 7])
def test_bpe_tree_is_tiktoken(leaf):
    import public_tokenizers

    enc = bpe.encoding(public_tokenizers.path(bpe.DEFAULT_RANKS), public_tokenizers.PATTERN)
    rnd = random.Random(leaf)
    for _ in range(400):
        t = "".join(rnd.choice(["a", "b", " ", "  ", "\n", "'re", "'l", "'", "é", "1", "!", "語", "\x1c", "\x85", "　"]) for _ in range(rnd.randrange(50)))
        ids = bpe.encode(enc, t, leaf)
        assert ids == enc.encode_ordinary(t) and bpe.decode(enc, ids, 2) == t.encode()


def test_bpe_null_is_empty(spark):
    import public_tokenizers

    got = bpe.bpe_digests(spark.createDataFrame([(1, None)], "doc_id long, text string"), public_tokenizers.path(bpe.DEFAULT_RANKS), public_tokenizers.PATTERN).first()
    assert got["n_tokens"] == 0 and got["ids_sha256"] == hashlib.sha256(b"").hexdigest()


def test_warc_round_trip(spark, tmp_path):
    evil = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Page-ID: 77\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    pages = [(1, "u\r\nWARC-Type: x", "a"), (2, None, None), (3, "z", ""), (4, "q", evil), (5, "q", evil + "x" + evil + "WARC/1.1\r\n"), (6, "q", "WARC/1.1\r\n"), (7, "q", evil), (8, "q", "é\r\n\r\nWARC/1.1\r\nContent-Length: 99999\r\nWARC-Type: response\r\n\r\n"), (9, "q", "\n\r")]
    path = str(tmp_path / "w")
    warc.write_warc(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1), path)
    last = {}
    for p, _, h in pages:
        last[h or ""] = max(p, last.get(h or "", p))
    want = {(p, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), "response" if last[h or ""] == p else "revisit", None if last[h or ""] == p else last[h or ""]) for p, _, h in pages}
    assert set(map(tuple, warc.read_warc(spark, path).collect())) == want


def vectors(kind):
    """Sets of vectors of many shapes."""
    rnd = np.random.default_rng(3)
    if kind == "isotropic":
        x = rnd.standard_normal((5000, 32))
        x[2000:2600] = x[rnd.integers(0, 2000, 600)] + 0.2 * rnd.standard_normal((600, 32))
        x[2600:2660] = x[0] + 0.15 * rnd.standard_normal((60, 32))
    elif kind == "two":
        x = np.ones((2, 8)) + 0.01 * rnd.standard_normal((2, 8))
    elif kind == "cluster":
        x = np.ones(16) + 0.1 * rnd.standard_normal((60, 16))
    elif kind == "plane":
        x = rnd.standard_normal((3000, 2))
    elif kind == "tight":
        x = np.concatenate([3 * np.ones((2300, 64)) + 0.1 * rnd.standard_normal((2300, 64)), rnd.standard_normal((2300, 64))])
    else:  # most cosines about the number given
        x = rnd.standard_normal((2600, 48)) + np.sqrt(float(kind) / (1 - float(kind))) * 48**0.5 * np.eye(48)[0]
    return np.float32(x)


@pytest.mark.parametrize("kind", ["isotropic", "two", "cluster", "plane", "tight", "0.9", "0.94"])
def test_embedding_recall(spark, kind):
    x = vectors(kind)
    y = x.astype(np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    near = y @ y.T >= 0.95
    np.fill_diagonal(near, False)
    table = spark.createDataFrame(pa.table({"vec_id": pa.array(range(len(x)), pa.int64()), "embedding": pa.array(x.tolist(), pa.list_(pa.float32()))})).repartition(8)
    got = embedding_dedup.near_duplicates(table).toPandas().set_index("vec_id").sort_index()
    found, true = got.n_links.to_numpy(), near.sum(axis=1)
    assert (found <= true).all() and found.sum() >= 0.99 * true.sum() > 0
    if found.sum() == true.sum():
        label = np.arange(len(x))
        while True:
            least = np.minimum(label, np.where(near, label[None, :], len(x)).min(axis=1))
            if (least == label).all():
                break
            label = least
        assert (got.component_id.to_numpy() == label).all()
    assert (got.kept == (got.index == got.component_id)).all()


def test_embedding_odd_rows(spark):
    nan, inf, e = float("nan"), float("inf"), [1.0, 0.0, 2.0]
    rows = [(1, e, 0), (1, e, 1), (None, e, 2), (7, None, 0), (8, [], 0), (9, [0.0, 0.0], 0), (10, [nan, 1.0], 0), (11, [inf], 0), (12, [1.0, None], 0), (13, [2.0, 0.0, 4.0], 0), (14, [1.0, 0.0], 0), (15, [3.0, 0.0], 0), (16, [-1.0, 0.0], 0), (None, [5.0], 0), (None, [6.0], 0), (20, [1e300, 1e300, 0.0, 0.0], 0), (19, [1e-300, 1e-300, 0.0, 0.0], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links int")
    got = sorted(map(tuple, embedding_dedup.near_duplicates(table).collect()), key=str)
    want = [(1, 3, 1, True), (1, 3, 1, True), (None, 3, 1, False), (13, 3, 1, False), (14, 1, 14, True), (15, 1, 14, False), (16, 0, 16, True), (None, 1, None, False), (None, 1, None, False), (19, 1, 19, True), (20, 1, 19, False)]
    want += [(i, 0, i, True) for i in (7, 8, 9, 10, 11, 12)]
    assert got == sorted(want, key=str)
    assert embedding_dedup.near_duplicates(table.limit(0)).collect() == []
    named = embedding_dedup.near_duplicates(table.withColumn("vec_id", F.concat(F.lit("v"), "vec_id")))
    assert named.where("vec_id = 'v15'").first()["component_id"] == "v14"


def test_mix_meets_targets(spark):
    rows = [(i, "w " * (1 + i % 7), None, f"s{i % 3}", "") for i in range(900)]
    out = mixing.mix(spark.createDataFrame(rows, DOC)).toPandas()
    assert (out.taken <= 3 * out["size"]).all() and out.taken.sum() == out["size"].sum()
    by = out.groupby("target").taken.sum()
    assert all(abs(t - k) <= 0.02 * k for k, t in by.items())


def test_pii_scores_and_redaction(spark):
    t = "ssn 123-45-6789, iban GB82 WEST 1234 5698 7654 32, not 123-45-6789x; mail a@b.co"
    found = pii.find_pii(spark.createDataFrame([(1, t)], "doc_id long, text string"))
    kinds = Counter(s["kind"] for s in found.first()["spans"])
    assert kinds["iban"] == 1 and kinds["email"] == 1 and kinds["ssn"] >= 1
    assert "[IBAN]" in pii.redact(found).first()["text"]


def test_bpe_columns_round_trip(spark):
    import public_tokenizers

    ranks, pattern = public_tokenizers.path(bpe.DEFAULT_RANKS), public_tokenizers.PATTERN
    docs = spark.createDataFrame([(1, "héllo wörld\n", [9]), (2, None, None)], "doc_id long, text string, token_ids array<int>")
    got = bpe.bpe_decode(bpe.bpe_encode(docs, ranks, pattern, check=True), ranks, pattern).orderBy("doc_id").collect()
    assert [bytes(r["decoded"]) for r in got] == ["héllo wörld\n".encode(), b""]
    assert got[1]["token_ids"] == [] and got[1]["decoded_sha256"] == hashlib.sha256(b"").hexdigest()


def longest_matches(text, known):
    """Phrases of text by searching known for ever longer pieces."""
    at = n = 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in known:
            size += 1
        at, n = at + size, n + 1
    return n


def test_phrases_against_longest_substrings():
    rnd = random.Random(3)
    for known in (" banana bandana nab ", " the theme then thaws the then ", " é漢字𝄞 ", "a"):
        root = language_id.suffix_automaton(known)
        for _ in range(300):
            text = "".join(rnd.choice("bandthemws é漢𝄞x") for _ in range(rnd.randrange(60)))
            assert language_id.phrases(text, root) == longest_matches(text, known), (text, known)


def test_phrases_are_counted_language_by_language(monkeypatch):
    model, taken, count = [language_id.suffix_automaton(t) for t in (" the cat ", " der hund ")], [], language_id.phrases
    monkeypatch.setattr(language_id, "phrases", lambda text, root: taken.append(next(i for i, x in enumerate(model) if x is root)) or count(text, root))
    texts = [" the hund ", "", " cat "]
    assert language_id.phrase_counts(texts, model).tolist() == [[count(t, root) for root in model] for t in texts]
    assert taken == [0, 0, 0, 1, 1, 1]
    assert language_id.phrase_counts([], model).shape == (0, 2)


def test_language_against_brute_force(spark):
    learn = {"aa": language_id.normalised("the cat sat on the mat, the end"), "bb": language_id.normalised("der Hund liegt auf dem Boden")}
    texts = ["The cat", "der Hund!", "½ ²", "①", "Ⅷ 12", "", None, "x" * 500, "catdog " * 2000, "कि", "the\u0301 cat"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in language_id.language_id(rows, learn).collect()}
    for i, t in enumerate(texts):
        text = language_id.normalised(t)
        if not any(ch.isalpha() for ch in t or ""):
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        cost = sorted((longest_matches(text, k) * np.log2(len(k)), lang) for lang, k in learn.items())
        assert got[i]["lang_pred"] == cost[0][1] and abs(got[i]["score"] - (1 - cost[0][0] / cost[1][0])) < 1e-12
    tie = language_id.language_id(rows, {"zz": learn["aa"], "yy": learn["aa"]}).where("doc_id = 0").first()
    assert (tie["lang_pred"], tie["score"]) == ("yy", 0.0)


def test_language_learns_from_labelled_halves_only(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("some words").alias("text"), F.when(language_id.held_out(F.col("id")), "zz").otherwise("en").alias("lang"))
    assert set(language_id.fit(docs)) == {"en"}
    with pytest.raises(ValueError):
        language_id.fit(docs.withColumn("lang", F.col("doc_id").cast("string")), max_langs=3)
