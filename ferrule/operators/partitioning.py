"""Partition layouts: what a source declares, and the clause that a target can have."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ferrule.functions.redo import split_at

#: Column types that a RANGE or LIST key may have as they are; others need COLUMNS.
INTEGER = ("TINYINT", "SMALLINT", "INT", "INTEGER", "BIGINT")
#: Types that no partition key may have.
REFUSED = ("BLOB", "LONGBLOB", "LONGTEXT", "TEXT", "FLOAT", "DOUBLE", "JSON", "GEOMETRY")


@dataclass(frozen=True)
class Layout:
    """kind and sub_kind: RANGE, LIST, HASH or NONE; parts: (name, bound text); interval layouts grow by themselves."""

    kind: str
    columns: tuple[str, ...]
    parts: tuple[tuple[str, str], ...] = ()
    sub_kind: str = "NONE"
    sub_columns: tuple[str, ...] = ()
    sub_count: int = 0
    interval: bool = False
    count: int = 0


def bound(text: str) -> str | None:
    """A bound as the target writes it: MAXVALUE, a number, or quoted text of a date or a string; null for what is none of these."""
    t = text.strip()
    if t.upper() in ("MAXVALUE", "DEFAULT", "NULL"):
        return t.upper()
    if re.fullmatch(r"[+-]?\d+(\.\d+)?", t):
        return t
    call = re.match(r"(?:TO_DATE|TO_TIMESTAMP|TIMESTAMP|DATE)\s*\(?\s*'([^']*)'", t, re.I)
    if call:
        stamp = call[1].strip()
        return f"'{stamp[:10] if re.fullmatch(r'.{10} 00:00:00(?:\\.0+)?', stamp) else stamp}'"
    if re.fullmatch(r"N?'(?:[^']|'')*'", t, re.I | re.S):
        return t[t.index("'") :]
    return None


def bounds(text: str) -> list[str | None]:
    """The bounds of a list or of a key of many columns."""
    return [bound(x) for x in split_at(text.strip(), ",")] if text.strip() else []


def missing_from_key(layout: Layout, primary_key: list[str]) -> list[str]:
    """Partition columns, sub-partition ones too, that a primary key lacks, in order; without a key none."""
    have, out = {k.lower() for k in primary_key}, []
    for c in (*layout.columns, *(layout.sub_columns if layout.sub_kind == "HASH" else ())):
        if primary_key and c.lower() not in have and c.lower() not in {x.lower() for x in out}:
            out.append(c)
    return out


def label(layout: Layout) -> str:
    """RANGE, or RANGE-HASH where there are sub-partitions."""
    return layout.kind if layout.sub_kind in ("", "NONE") else f"{layout.kind}-{layout.sub_kind}"


def clause(layout: Layout, types: dict[str, str], primary_key: list[str] = (), quote: str = "`") -> tuple[str, list[str]]:
    """(clause, warnings): the target's PARTITION BY text, empty where the layout cannot be had, and why.

    types: target types of columns. Whole-number RANGE and LIST keys of one column stand bare, others as COLUMNS; a sub-layout
    other than HASH is left out; an interval layout becomes its present ranges and one without an upper bound.
    """
    warnings: list[str] = []
    base = lambda c: re.sub(r"\(.*", "", {k.lower(): v for k, v in types.items()}.get(c.lower(), "")).strip().upper()
    lacking = missing_from_key(layout, list(primary_key))
    if lacking:
        return "", [f"primary key lacks partition column {', '.join(lacking)}"]
    for c in (*layout.columns, *layout.sub_columns):
        if base(c) in REFUSED:
            return "", [f"partition column {c} has type {base(c)}"]
        if base(c) in ("NUMERIC", "DECIMAL", "NUMBER"):
            return "", [f"partition column {c} is {types.get(c, 'NUMERIC')}; only BIGINT and smaller can be a partition key"]
    names = lambda cols: ", ".join(f"{quote}{c}{quote}" for c in cols)
    whole = len(layout.columns) == 1 and base(layout.columns[0]) in INTEGER
    sub = ""
    if layout.sub_kind == "HASH" and layout.sub_columns and layout.sub_count > 0:
        if all(base(c) in INTEGER for c in layout.sub_columns) and len(layout.sub_columns) == 1:
            sub = f" SUBPARTITION BY HASH ({names(layout.sub_columns)}) SUBPARTITIONS {layout.sub_count}"
        else:
            sub = f" SUBPARTITION BY KEY ({names(layout.sub_columns)}) SUBPARTITIONS {layout.sub_count}"
            warnings.append(f"sub-partitions by {', '.join(layout.sub_columns)} are dealt by KEY")
    elif layout.sub_kind not in ("", "NONE"):
        warnings.append(f"sub-partitions by {layout.sub_kind} are left out")
    if layout.kind == "HASH":
        count = layout.count or len(layout.parts)
        if count < 1:
            return "", ["a HASH layout without partitions"]
        word = "HASH" if whole else "KEY"
        return f"PARTITION BY {word} ({names(layout.columns)}) PARTITIONS {count}", warnings
    if layout.kind not in ("RANGE", "LIST"):
        return "", [f"layout {layout.kind} has no counterpart"]
    body, open_end = [], False
    for name, text in layout.parts:
        got = bounds(text)
        if not got or None in got:
            return "", [f"bound {text!r} of partition {name} is not understood"]
        if layout.kind == "LIST" and "DEFAULT" in got:
            return "", [f"partition {name} takes DEFAULT, which the target has not"]
        open_end |= layout.kind == "RANGE" and set(got) == {"MAXVALUE"}
        word = "LESS THAN" if layout.kind == "RANGE" else "IN"
        inner = ", ".join(got)
        body.append(f"PARTITION {quote}{name}{quote} VALUES {word} {'MAXVALUE' if whole and inner == 'MAXVALUE' else f'({inner})'}")
    if layout.interval and not open_end:
        most = "MAXVALUE" if whole else "(" + ", ".join(["MAXVALUE"] * len(layout.columns)) + ")"
        body.append(f"PARTITION {quote}p_max{quote} VALUES LESS THAN {most}")
        warnings.append("the interval is not kept; rows beyond the present ranges meet in p_max")
    if not body:
        return "", ["a layout without partitions"]
    return f"PARTITION BY {layout.kind}{'' if whole else ' COLUMNS'} ({names(layout.columns)}){sub} ({', '.join(body)})", warnings


def create_table(name: str, columns: list[tuple[str, str, bool]], primary_key: list[str], layout: Layout | None, quote: str = "`") -> tuple[str, list[str]]:
    """(DDL, warnings): columns are (name, target type, nullable). A NUMERIC(p,0) partition key of up to 18 digits becomes
    BIGINT; where the primary key lacks a partition column the table is made without partitions; any other layout that
    the target cannot have is an error."""
    keys = {c.lower() for c in (*layout.columns, *layout.sub_columns)} if layout else set()
    narrow = lambda c, t: "BIGINT" if c.lower() in keys and re.fullmatch(r"(?:NUMERIC|DECIMAL)\((?:[1-9]|1[0-8])(?:,\s*0)?\)", t, re.I) else t
    typed = [(c, narrow(c, t), n) for c, t, n in columns]
    lines = [f"{quote}{c}{quote} {t}{'' if n else ' NOT NULL'}" for c, t, n in typed]
    if primary_key:
        lines.append(f"PRIMARY KEY ({', '.join(f'{quote}{k}{quote}' for k in primary_key)})")
    text, warnings = "", []
    if layout:
        text, warnings = clause(layout, {c: t for c, t, _ in typed}, primary_key, quote)
        if not text and not missing_from_key(layout, primary_key):
            raise ValueError("; ".join(warnings))
    return f"CREATE TABLE {quote}{name}{quote} ({', '.join(lines)}){' ' + text if text else ''}", warnings


#: The least and greatest whole number that a target sequence holds.
LEAST, GREATEST = -(2**63), 2**63 - 1


def sequence_ddl(name: str, last: int, step: int = 1, low: int = 1, high: int = GREATEST, cycle: bool = False, cache: int = 0, quote: str = "`") -> str:
    """DDL of a sequence that goes on where the source stands; values are moved into the target's range."""
    held = lambda x: max(LEAST, min(GREATEST, x))
    text = f"CREATE SEQUENCE {quote}{name}{quote} START WITH {held(last)} INCREMENT BY {step} MINVALUE {held(low)} MAXVALUE {held(high)}"
    return f"{text} {'CYCLE' if cycle else 'NOCYCLE'} {f'CACHE {cache}' if cache > 1 else 'NOCACHE'}"
