"""Canonical text of values, so that equal values of different stores compare and hash as equal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _tag(kind: str, text: Column) -> Column:
    """[kind, text] as JSON; the text needs no escapes."""
    return F.concat(F.lit(f'["{kind}","'), text, F.lit('"]'))


def _tag_any(kind: str, text: Column) -> Column:
    """[kind, text] as JSON; only a text that is not plain ASCII goes through the JSON writer."""
    return F.when(text.rlike(r"[^ !#-\[\]-~]"), F.to_json(F.array(F.lit(kind), text))).otherwise(_tag(kind, text))


def _zeros(n: Column) -> Column:
    return F.repeat(F.lit("0"), F.greatest(n, F.lit(0)).cast("int"))


def _let(value: Column, f) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.transform(F.array(value), f)[0]


def _plain(text: Column) -> Column:
    """Plain digits of a number's text without sign, which may have a point and an exponent."""

    def parts(t: Column) -> Column:
        whole = F.regexp_extract(t, r"^([0-9]+)", 1)
        power = F.coalesce(F.regexp_extract(t, r"E([+-]?[0-9]+)$", 1).try_cast("int"), F.lit(0))
        return F.struct(F.concat(whole, F.regexp_extract(t, r"\.([0-9]+)", 1)).alias("d"), (F.length(whole) + power).alias("p"))

    def laid(x: Column) -> Column:
        digits, point = x["d"], x["p"]
        inside = F.greatest(point, F.lit(0))
        return (
            F.when(point <= 0, F.concat(F.lit("0."), _zeros(-point), digits))
            .when(point >= F.length(digits), F.concat(digits, _zeros(point - F.length(digits))))
            .otherwise(F.concat(F.substr(digits, F.lit(1), inside), F.lit("."), F.substr(digits, inside + 1)))
        )

    bare = lambda x: F.when(x.contains("."), F.rtrim(F.rtrim(x, F.lit("0")), F.lit("."))).otherwise(x)
    done = lambda x: F.when(x.rlike("^0*$"), "0").otherwise(F.regexp_replace(x, r"^0+(?=[0-9])", ""))
    short = F.regexp_replace(text, r"\.0(?=E|$)", "")
    return _let(_let(_let(_let(short, parts), laid), bare), done)


def plain_number(c: Column, kind: T.DataType) -> Column:
    """A number without exponent or trailing zeros, over the whole range of its type; zero has no sign."""
    text = c.cast("string")
    if not isinstance(kind, T.FractionalType):
        return text
    if isinstance(kind, T.DecimalType):
        bare = F.when(text.contains("."), F.rtrim(F.rtrim(text, F.lit("0")), F.lit("."))).otherwise(text)
        return bare if kind.scale <= 6 else F.when(text.contains("E"), _any_number(text)).otherwise(bare)
    whole = (F.abs(c) < (1 << 24 if isinstance(kind, T.FloatType) else 10**15)) & (c == F.rint(c))  # all digits of these are exact
    laid = (F.abs(c) >= 1e-3) & (F.abs(c) < 1e7)  # these have no exponent
    return F.when(whole, c.cast("long").cast("string")).when(laid, text).when(text.contains("E"), _let(text, _moved)).otherwise(text)


def _moved(text: Column) -> Column:
    """Plain digits of a text such as -1.25E-7: one digit, not 0, before the point, and no zeros at the end but in .0."""
    power = F.substring_index(text, "E", -1).cast("int")
    digits = F.concat(F.repeat(F.lit("0"), -power), F.regexp_replace(text, r"(\.0)?E.*|[-.]", ""))
    point = F.greatest(power, F.lit(0)) + 1
    after = F.regexp_replace(F.substr(digits, point + 1), "^(?=.)", ".")
    return F.concat(F.when(text.startswith("-"), "-").otherwise(""), F.rpad(digits, point, F.lit("0")), after)  # rpad cuts, too


def _any_number(text: Column) -> Column:
    """Plain digits of any number's text, with its sign; other texts, such as NaN, as they are."""
    signed = lambda b: F.when(text.startswith("-") & (b != "0"), F.concat(F.lit("-"), b)).otherwise(b)
    return F.when(text.rlike("^-?[0-9]"), _let(_plain(F.regexp_replace(text, "^-", "")), signed)).otherwise(text)


def canonical(c: Column, kind: T.DataType, fixed_char: bool = False) -> Column:
    """["null"], ["bytes",n,digest], ["bool",b], ["number",t], ["datetime",t] or ["text",t] as JSON text."""
    if isinstance(kind, T.BinaryType):
        out = F.concat(F.lit('["bytes",'), F.octet_length(c).cast("string"), F.lit(',"'), F.base64(F.unhex(F.sha2(c, 256))), F.lit('"]'))
    elif isinstance(kind, T.BooleanType):
        out = F.concat(F.lit('["bool",'), c.cast("string"), F.lit("]"))
    elif isinstance(kind, T.NumericType):
        out = _tag("number", plain_number(c, kind))
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        text = c.cast("string")  # its fraction has no trailing zeros
        out = _tag("datetime", F.when(text.contains("."), F.rpad(text, F.instr(text, ".") + 6, F.lit("0"))).otherwise(text))
    elif isinstance(kind, T.DateType):
        out = _tag("datetime", F.date_format(c, "yyyy-MM-dd"))
    elif isinstance(kind, T.YearMonthIntervalType):
        out = _tag("text", interval_text(F.extract(F.lit("year"), c).cast("int") * 12 + F.extract(F.lit("month"), c).cast("int")))
    else:
        text = c.cast("string") if isinstance(kind, T.StringType) else F.to_json(c) if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)) else c.cast("string")
        out = _tag_any("text", F.rtrim(text) if fixed_char else text)
    return F.when(c.isNull(), '["null"]').otherwise(out)


def interval_text(months: Column) -> Column:
    """Months as sign, four-digit years and two-digit months, such as +0026-08."""
    n = F.abs(months)
    return F.concat(F.when(months < 0, "-").otherwise("+"), F.lpad(F.floor(n / 12).cast("string"), 4, "0"), F.lit("-"), F.lpad((n % 12).cast("string"), 2, "0"))


def record(df: DataFrame, columns: list[str] | None = None, fixed_char: frozenset[str] = frozenset()) -> Column:
    """A row as one JSON array of canonical values, in column order; names fold as Spark folds them."""
    kinds = {f.name.lower(): f.dataType for f in df.schema}
    names = columns or df.columns
    return F.concat(F.lit("["), F.concat_ws(",", *(canonical(F.col(n), kinds[n.lower()], n in fixed_char) for n in names)), F.lit("]"))
