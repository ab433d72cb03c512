"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over a bounded sample of labelled text. A text, its letters in lower
case and all else between words as one space, is parsed against it from left to right into longest matches, across
words; a character that the automaton has never seen is a phrase of its own. A text's cost in a language is its
number of phrases times log2 of the automaton's training length, over its letters: the cross-parsing estimate of
entropy. The least cost wins; ties go to the language first by code point.

What is learned: for each language the ``docs_per_lang`` labelled documents with the least hash of
their id, at most ``chars_per_doc`` characters from each, ``chars_per_lang`` in all. These documented
bounds keep what reaches the driver and is broadcast below ``max_langs * chars_per_lang`` characters; more languages
than ``max_langs`` are refused. Prediction reads every whole text.

Defined cases: null text, or text without a letter (Unicode categories L), is ``und`` with score 0; without any
labelled text all are ``und``; with one language alone all texts with letters are of it, with score 1; repeated rows
give equal rows; other columns are ignored, carried ones must not bear the names of the result's own; an empty
table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ferrule.llm import common as c

_WORDS = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def normalised(text: str | None) -> str:
    """The words of a text in lower case, a space before and after each; nothing if there is no letter."""
    words = _WORDS.findall(text.lower()) if text else []
    return f" {' '.join(words)} " if words else ""


def suffix_automaton(text: str) -> dict[str, dict]:
    """The root of the automaton of all substrings of text; a state is a dict from characters to states."""
    link, length, states, last = [-1], [0], [{}], 0
    for ch in text:
        cur = len(length)
        length.append(length[last] + 1)
        link.append(0)
        states.append({})
        p = last
        while p >= 0 and ch not in states[p]:
            states[p][ch] = cur
            p = link[p]
        if p >= 0:
            q = states[p][ch]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                twin = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                states.append(dict(states[q]))
                while p >= 0 and states[p].get(ch) == q:
                    states[p][ch] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    for s in states:
        for ch, to in s.items():
            s[ch] = states[to]
    return states[0]


def phrases(text: str, root: dict[str, dict]) -> int:
    """Number of longest matches that text falls into from left to right; a character that never occurs is one."""
    n, nowhere = 0, {}
    state = nowhere
    for ch in text:
        state = state.get(ch)
        if state is None:
            n += 1
            state = root.get(ch, nowhere)
    return n


def phrase_counts(texts: list[str], model: list[dict]) -> np.ndarray:
    """Phrases of each text in each automaton, a row a text; one automaton after the other, as the cache holds one at best."""
    return np.array([[phrases(t, root) for t in texts] for root in model], np.int64).reshape(len(model), len(texts)).T


def sample_texts(labelled: DataFrame, docs_per_lang: int, chars_per_doc: int, chars_per_lang: int, max_langs: int) -> dict[str, str]:
    """The bounded training text of each language; labelled has (key, text, lang)."""
    known = labelled.where("lang IS NOT NULL AND text IS NOT NULL")
    langs = known.select("lang").distinct().limit(max_langs + 1).count()
    if langs > max_langs:
        raise ValueError(f"more than {max_langs} languages; raise max_langs")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "key"))
    chosen = known.select("lang", "key", F.xxhash64(F.col("key").cast("string")).alias("h"))
    chosen = chosen.withColumn("r", rank).where(F.col("r") <= docs_per_lang).select("key", "lang", "r")  # docs_per_lang * max_langs rows
    rows = labelled.join(F.broadcast(chosen), ["key", "lang"]).groupBy("lang", "r").agg(F.min(F.substring("text", 1, chars_per_doc)).alias("t")).collect()
    by: dict[str, list] = {}
    for x in rows:
        by.setdefault(x["lang"], []).append((x["r"], x["t"]))
    out = {}
    for lang, found in sorted(by.items()):
        out[lang] = normalised(" ".join(t for _, t in sorted(found)))[: chars_per_lang + 2]
    return {lang: text for lang, text in out.items() if text.strip()}


def language_id(docs: DataFrame, texts: dict[str, str], id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, lang_pred, score) and the carried columns of every row. score: by how much the second best costs more, 0 to 1."""
    c.carried(docs, carry, ("doc_id", "lang_pred", "score"))
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text"), *carry)
    texts = dict(sorted(texts.items()))
    names = list(texts)
    weight = np.array([math.log2(max(4, len(t))) for t in texts.values()])

    @c.tidy
    def run(batches):
        model = [suffix_automaton(t) for t in texts.values()]  # some 12 MB a language, for this task alone
        for b in batches:
            for k in range(0, len(b), 512):
                yield one(b.slice(k, 512), model)

    def one(part, model):
        words = [normalised(t.as_py()) for t in part.column(1)]
        lang, score = np.full(len(words), "und", object), np.zeros(len(words))
        full = np.array([bool(w) for w in words], bool)
        if full.any() and names:
            total = phrase_counts(words, model) * weight
            order = np.argsort(total, axis=1, kind="stable")
            best = total[np.arange(len(words)), order[:, 0]]
            second = total[np.arange(len(words)), order[:, 1]] if len(names) > 1 else np.full(len(words), np.inf)
            lang[full] = np.array(names, object)[order[full, 0]]
            score[full] = 1 - best[full] / np.maximum(second[full], 1e-9)
        return pa.RecordBatch.from_arrays([part.column(0), *part.columns[2:], pa.array(lang, pa.string()), pa.array(np.clip(score, 0, 1))], ["doc_id", *carry, "lang_pred", "score"])

    kinds = ", ".join(f"{x} {src.schema[x].dataType.simpleString()}" for x in ("doc_id", *carry))
    return src.mapInArrow(run, f"{kinds}, lang_pred string, score double")


def fit(docs: DataFrame, docs_per_lang: int = 200, chars_per_doc: int = 2000, chars_per_lang: int = 40_000, max_langs: int = 256, id_col: str = "doc_id") -> dict[str, str]:
    """Training texts from the documents whose crc32 of the id is not 2 modulo 4."""
    key = F.col(id_col).alias("key")
    return sample_texts(docs.where(~held_out(F.col(id_col))).select(key, "text", "lang"), docs_per_lang, chars_per_doc, chars_per_lang, max_langs)


def held_out(id_col):
    """Documents that nothing is learned from."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = language_id(docs, fit(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
