"""Quality rules as a short-circuit cascade, in DataFrame functions alone.

Each rule is one boolean expression that rejects a document. Before the run every rule is timed and its
rejections are counted on a bounded sample; the rules then stand in one ``CASE`` in the order of rejection per
cost, so that a document leaves at the first rule that rejects it. The order changes the cost of a run,
never its verdicts: a document is kept if no rule rejects it.

Words in repeated windows are counted without a shuffle: the hashes of a text's windows go into one
array; only where that array holds a value twice is it sorted with its positions.

Defined cases: null or blank text has 0 words and fails the base; repeated rows give equal rows; other
columns are ignored; an empty sample leaves the rules in the order given.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.llm.common import GAP, SPACES, Scratch

SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: Rules that reject; Spark SQL over the features, text and lines.
RULES = {
    "symbols": "10 * n_symbols > 3 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 15 * n_words",
    "duplicate_lines": "2 * n_dup_lines > n_lines",
    "few_letters": r"2 * length(regexp_replace(text, '\\P{L}+', '')) < word_chars",
    "ellipsis_lines": r"10 * size(filter(lines, x -> x rlike '(\\.\\.\\.|…)[ \\t\\r]*$')) > 3 * n_lines",
    "bullet_lines": r"10 * size(filter(lines, x -> x rlike '^[ \\t]*[-*•]')) > 9 * n_lines",
}


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, lines, n_lines, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    bare = F.btrim("text", F.lit(SPACES))
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    split = base.withColumns({
        "w": F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, GAP)),
        "lines": F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != ""),
        "word_chars": F.length(F.translate("text", SPACES, "")).cast("long"),
        "n_symbols": (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long"),
    })
    seen = split.withColumns({
        "n_words": F.size("w").cast("long"),
        "n_lines": F.size("lines").cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "win": F.when(F.size("w") > WINDOW, F.transform(F.sequence(F.lit(1), F.size("w") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("w", i, WINDOW)))),
    })
    # rand() keeps filters on the result above this projection; pushed below, they would repeat the arrays' work for each element
    marked = seen.withColumn("s", F.when((F.rand(0) >= 0) & (F.size(F.array_distinct("win")) < F.size("win")), F.sort_array(F.transform("win", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))))
    twice = F.expr("transform(filter(sequence(0, size(s) - 1), i -> get(s, i).h = get(s, i - 1).h OR get(s, i).h = get(s, i + 1).h), i -> get(s, i).p)")
    covered = F.aggregate(
        F.sort_array(twice),
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last")),
        lambda a: a["n"],
    )
    return marked.withColumn("n_repeat_words", F.when(F.col("s").isNull(), F.lit(0)).otherwise(covered).cast("long")).drop("w", "win", "s")


def base_failed() -> Column:
    return F.expr("n_words < 20 OR 100 * n_repeat_words > 30 * n_words")


def rule_order(sample: DataFrame, rules: dict[str, str], repeats: int = 8) -> list[str]:
    """Rules by rejection per cost on the sample, best first; ties in the order given.

    One job counts what each rule rejects. A rule's cost is the time that the sample's rows, each ``repeats``
    times, take under it, less that of the bare rows, the least of two runs each, so that start-up and code
    generation do not count for it.
    """
    with Scratch(sample.sparkSession) as s:
        held = s.table(features(sample), "op1-sample").where(~base_failed()).coalesce(1).cache()
        try:
            found = held.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.expr(r)).alias(k) for k, r in rules.items())).first()

            def seconds(r: str) -> float:
                again, runs = held.withColumn("__again", F.explode(F.sequence(F.lit(1), F.lit(repeats)))), []
                for _ in range(2):
                    began = time.perf_counter()
                    again.agg(F.count_if(F.expr(r))).collect()
                    runs.append(time.perf_counter() - began)
                return min(runs)

            bare = seconds("true")
            gain = {k: found[k] / max(1, found["n"]) / max(1e-6, seconds(r) - bare) for k, r in rules.items()}
        finally:
            held.unpersist()
    return sorted(rules, key=lambda k: -gain[k])


def quality_rules(docs: DataFrame, sample: DataFrame | None = None, rules: dict[str, str] | None = None, sample_rows: int = 512) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept)."""
    rules = RULES if rules is None else rules
    sample = (docs if sample is None else sample).limit(sample_rows)
    cascade = "CASE " + " ".join(f"WHEN {rules[k]} THEN false" for k in rule_order(sample, rules)) + " ELSE true END" if rules else "true"
    out = features(docs).withColumn("base_failed", base_failed()).withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(F.expr(cascade)))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality_rules(docs, docs.sample(0.02, seed=5))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
win AS (SELECT rid, p, sha256(array_to_string(w[p:p + 7], ' ')) AS k FROM (SELECT rid, w, unnest(generate_series(1, len(w) - 7)) AS p FROM d WHERE len(w) >= 8)),
twice AS (SELECT rid, p FROM win QUALIFY count(*) OVER (PARTITION BY rid, k) > 1),
rep AS (SELECT rid, count(DISTINCT q) AS n FROM (SELECT rid, unnest(generate_series(p, p + 7)) AS q FROM twice) GROUP BY rid),
f AS (SELECT doc_id, text, lines, len(lines) AS n_lines, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
      FROM d LEFT JOIN rep USING (rid)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > 3 * n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 2 * n_dup_lines > n_lines
            OR 2 * length(regexp_replace(text, '\P{L}+', '', 'g')) < word_chars
            OR 10 * len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[ \t\r]*$'))) > 3 * n_lines
            OR 10 * len(list_filter(lines, lambda x: regexp_matches(x, '^[ \t]*[-*•]'))) > 9 * n_lines) AS kept
FROM b
"""
