"""Identifier policies: case folding, name maps and collisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POLICIES = ("auto", "preserve", "lower", "upper")


def resolve_policy(policy: str, folds_names: int | None) -> str:
    """auto is lower where the target folds names (1), else preserve; a folding target refuses the others."""
    if policy not in POLICIES:
        raise ValueError(f"unknown name policy {policy!r}")
    if policy == "auto":
        return "lower" if folds_names == 1 else "preserve"
    if folds_names == 1 and policy != "lower":
        raise ValueError("the target stores names in lower case")
    return policy


def apply_policy(name: Column, policy: str) -> Column:
    """Only the part after the last dot changes."""
    if policy == "preserve":
        return name
    last = F.substring_index(name, ".", -1)
    head = F.substr(name, F.lit(1), F.length(name) - F.length(last))
    return F.concat(head, F.upper(last) if policy == "upper" else F.lower(last))


def collisions(names: DataFrame, col: str, policy: str, folded: bool = True) -> DataFrame:
    """(target_name, sources): target names that several sources map to."""
    target = apply_policy(F.col(col), policy)
    return names.groupBy((F.lower(target) if folded else target).alias("target_name")).agg(F.count_distinct(col).alias("sources")).where("sources > 1")


def natural_key(name: Column) -> Column:
    """Sort key in which digit runs order as numbers: every digit run is padded to 12 places."""
    parts = F.regexp_extract_all(F.lower(name), F.lit("[0-9]+|[^0-9]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike("^[0-9]"), F.lpad(x, 12, "0")).otherwise(x)), "")


def parse_key_overrides(text: str) -> dict[str, list[str]]:
    """Lines ``table=c1,c2``; a table named twice is an error."""
    out: dict[str, list[str]] = {}
    for line in filter(None, (x.strip() for x in text.splitlines())):
        table, eq, cols = line.partition("=")
        keys = [x.strip() for x in cols.split(",") if x.strip()]
        if not eq or not table.strip() or not keys:
            raise ValueError(f"not table=column,...: {line!r}")
        if table.strip().lower() in (k.lower() for k in out):
            raise ValueError(f"{table.strip()} is named twice")
        out[table.strip()] = keys
    return out


def name_parts(name: Column, owner: str = "") -> tuple[Column, Column]:
    """Owner and object of a name such as owner.table, double quotes taken off; without an owner the one given."""
    bare = F.regexp_replace(name, '"', "")
    return F.when(bare.contains("."), F.substring_index(bare, ".", 1)).otherwise(F.lit(owner)), F.substring_index(bare, ".", -1)


def override_for(overrides: dict[str, list[str]], owner: str, name: str) -> list[str] | None:
    """The key override of a table by its owner and name, or by its name alone, in whatever case."""
    held = {k.lower(): v for k, v in overrides.items()}
    return held.get(f"{owner}.{name}".lower()) or held.get(name.lower())
