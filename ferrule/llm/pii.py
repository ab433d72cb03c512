"""Personal data: patterns propose spans, checksums confirm them, context words adjust their score.

DataFrame functions alone. Positions come from the pieces between the matches of a pattern: a span starts after
the lengths of all pieces and matches before it. Patterns use possessive repeats and begin at run
borders, so that a long run of characters is read once.

Base kinds and their validators: email; ip (parts up to 255); card (14 to 19 digits, Luhn); phone (10 to 15 digits).
They keep their spans whatever the score. The method adds iban (mod 97 confirms it) and ssn (no checksum: it
counts only where a context word stands within ``CONTEXT`` characters before it).

Positions are code points, ends exclusive. Defined cases: null counts as empty text; a match that its
validator refuses is dropped and not tried again from a later place; repeated rows give equal rows; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CONTEXT = 48
THRESHOLD = 0.5
_LOCAL = "A-Za-z0-9._%+-"

#: kind: (pattern, text that every match holds, score without context, context words)
KINDS = {
    "email": (rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, "mail|contact|write"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", 0.6, "ip|host|address|server"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", None, 0.8, "card|visa|credit|debit|payment"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.7, "tel|phone|call|fax|mobile"),
    "iban": (r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}\b", None, 0.8, "iban|account|bank|transfer"),
    "ssn": (r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "-", 0.3, "ssn|social security|tax id"),
}
BASE = ("email", "ip", "card", "phone")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _mod97(m: Column) -> Column:
    bare = F.replace(m, F.lit(" "), F.lit(""))
    turned = F.split(F.concat(F.substr(bare, F.lit(5)), F.substr(bare, F.lit(1), F.lit(4))), "")
    value = lambda x: F.conv(x, 36, 10).cast("int")
    return F.aggregate(turned, F.lit(0), lambda a, x: (a * F.when(value(x) > 9, 100).otherwise(10) + value(x)) % 97)


VALID = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: F.forall(F.split(m, r"\."), lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False))),
    "card": lambda m: F.length(_digits(m)).between(14, 19) & F.coalesce(F.call_function("luhn_check", _digits(m)), F.lit(False)),
    "phone": lambda m: F.length(_digits(m)).between(10, 15),
    "iban": lambda m: _mod97(m) == 1,
    "ssn": lambda m: F.lit(True),
}


def _spans(text: Column, kind: str) -> Column:
    """array<struct<start, rank, kind, end, score>> of a kind's confirmed spans."""
    pattern, holds, score, words = KINDS[kind]
    rank = list(KINDS).index(kind)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    none = F.expr("CAST(array() AS array<struct<start:int,end:int,m:string>>)")
    # only confirmed matches are gathered; the others just move the place on
    end = lambda a, x: a["at"] + F.length(x["p"]) + F.length(x["m"])
    placed = F.aggregate(
        F.zip_with(F.slice(pieces, F.lit(1), F.size(matches)), matches, lambda p, m: F.struct(p.alias("p"), m.alias("m"))),
        F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda a, x: F.struct(
            end(a, x).alias("at"),
            F.when(VALID[kind](x["m"]), F.array_append(a["out"], F.struct((a["at"] + F.length(x["p"])).alias("start"), end(a, x).alias("end"), x["m"].alias("m")))).otherwise(a["out"]).alias("out"),
        ),
        lambda a: a["out"],
    )
    near = lambda x: F.lower(F.substr(text, F.greatest(x["start"] + 1 - CONTEXT, F.lit(1)), F.least(x["start"], F.lit(CONTEXT)))).rlike(rf"\b(?:{words})")
    scored = F.transform(placed, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), x["end"].alias("end"), (F.lit(score) + F.when(near(x), 0.25).otherwise(0.0)).alias("score")))
    if kind not in BASE:
        scored = F.filter(scored, lambda x: x["score"] >= THRESHOLD)
    may = text.contains(holds) if holds else F.lit(True)
    return F.when(may & text.rlike(pattern), scored).otherwise(F.expr("CAST(array() AS array<struct<start:int,rank:int,kind:string,end:int,score:double>>)"))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, spans): spans in order of start and kind, each (start, rank, kind, end, score)."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = src.withColumns({f"_{k}": _spans(F.col("text"), k) for k in KINDS})
    return found.select("doc_id", "text", F.sort_array(F.concat(*(F.col(f"_{k}") for k in KINDS))).alias("spans"))


def redact(found: DataFrame) -> DataFrame:
    """(doc_id, text) with each span, or union of overlapping ones, replaced by ``[KIND]`` of the first."""
    cut = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, x: F.when(x["end"] <= a["at"], a).otherwise(F.struct(
            x["end"].alias("at"),
            F.when(x["start"] < a["at"], a["out"]).otherwise(F.concat(a["out"], F.substr(F.col("text"), a["at"] + 1, x["start"] - a["at"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))).alias("out"),
        )),
        lambda a: F.concat(a["out"], F.substr(F.col("text"), a["at"] + 1)),
    )
    return found.select("doc_id", cut.alias("text"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda x: x["rank"] < len(BASE))
    listed = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    n = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *(n(k) for k in BASE), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


_LUHN = "list_sum(list_transform(range(len(c)), lambda i: CASE WHEN i % 2 = 1 THEN 2 * c[len(c) - i]::INT // 10 + 2 * c[len(c) - i]::INT % 10 ELSE c[len(c) - i]::INT END)) % 10 = 0"
ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
m AS (SELECT rid, text, kind, rank, unnest(ms) AS v, unnest(generate_series(1, len(ms))) AS i, ms, ps FROM (
  SELECT rid, text, 'email' AS kind, 0 AS rank, regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS ms, string_split_regex(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS ps FROM d
  UNION ALL SELECT rid, text, 'ip', 1, regexp_extract_all(text, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), string_split_regex(text, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') FROM d
  UNION ALL SELECT rid, text, 'card', 2, regexp_extract_all(text, '[0-9]([\x20-]?[0-9])+'), string_split_regex(text, '[0-9]([\x20-]?[0-9])+') FROM d
  UNION ALL SELECT rid, text, 'phone', 3, regexp_extract_all(text, '\+[0-9][\x20().0-9-]+[0-9]'), string_split_regex(text, '\+[0-9][\x20().0-9-]+[0-9]') FROM d
  UNION ALL SELECT rid, text, 'iban', 4, regexp_extract_all(text, '\b[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{11,30}}\b'), string_split_regex(text, '\b[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{11,30}}\b') FROM d
  UNION ALL SELECT rid, text, 'ssn', 5, regexp_extract_all(text, '\b[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}\b'), string_split_regex(text, '\b[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}\b') FROM d)),
p AS (SELECT rid, text, kind, rank, v, string_split(regexp_replace(v, '[^0-9]', '', 'g'), '') AS c,
             (list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s FROM m),
ok AS (SELECT rid, kind, rank, s, s + length(v) AS e FROM p WHERE CASE kind
  WHEN 'email' THEN true
  WHEN 'ip' THEN len(list_filter(string_split(v, '.'), lambda x: coalesce(try_cast(x AS INT) <= 255, false))) = 4
  WHEN 'card' THEN len(c) BETWEEN 14 AND 19 AND {_LUHN}
  WHEN 'phone' THEN len(c) BETWEEN 10 AND 15
  WHEN 'iban' THEN list_reduce(list_prepend(0, list_transform(string_split(replace(v, ' ', '')[5:] || v[:4], ''), lambda x: CASE WHEN x BETWEEN '0' AND '9' THEN x::INT ELSE ascii(x) - 55 END)), lambda a, x: (a * CASE WHEN x > 9 THEN 100 ELSE 10 END + x) % 97) = 1
  ELSE regexp_matches(lower(text[greatest(s + 1 - 48, 1):s]), '\b(?:ssn|social security|tax id)') END),
g AS (SELECT rid, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
             string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < 4) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans FROM ok GROUP BY rid)
SELECT doc_id, coalesce(n_email, 0)::BIGINT AS n_email, coalesce(n_ip, 0)::BIGINT AS n_ip, coalesce(n_card, 0)::BIGINT AS n_card, coalesce(n_phone, 0)::BIGINT AS n_phone,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (rid)
"""
