"""Pieces of oracle SQL, made from the same rule tables as the Spark expressions."""

from __future__ import annotations

import re


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def fill(phrase: str, value: str) -> str:
    """``phrase`` with the SQL ``value`` in place of its first {}."""
    return f"({' || '.join([q(phrase.split('{}', 1)[0]), value, q(phrase.split('{}', 1)[1])])})"


def chain(expr: str, steps: list[tuple[str, str]]) -> str:
    for pattern, new in steps:
        flags = "g"
        if m := re.match(r"\(\?([a-z]+)\)", pattern):
            pattern = pattern[m.end() :] if m[1] != "m" and m[1] != "is" else pattern
            flags += "i" if "i" in m[1] and m[1] != "is" else ""
        expr = f"regexp_replace({expr}, {q(pattern)}, {q(new)}, '{flags}')"
    return expr


def strip(expr: str) -> str:
    return rf"regexp_replace({expr}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+\z', '', 'g')"


def words(expr: str) -> str:
    return rf"regexp_extract_all(coalesce({expr}, ''), '[^\s\p{{Z}}]+')"


def tokens(expr: str) -> str:
    return rf"regexp_extract_all(lower(coalesce({expr}, '')), '[\p{{L}}\p{{N}}_]+')"


def has(expr: str, pattern: str) -> str:
    return f"regexp_matches({expr}, {q(pattern)})"


def count_of(expr: str, part: str) -> str:
    return f"((length({expr}) - length(replace({expr}, {q(part)}, ''))) // {len(part)})"


def capitalise(expr: str) -> str:
    return f"(upper(substr({expr}, 1, 1)) || substr({expr}, 2))"


def cosine(a: str, b: str) -> str:
    """Of two token lists."""
    dot = f"list_sum(list_transform(list_distinct({a}), lambda t: len(list_filter({a}, lambda x: x = t)) * len(list_filter({b}, lambda x: x = t))))"
    norm = lambda v: f"sqrt(list_sum(list_transform(list_distinct({v}), lambda t: len(list_filter({v}, lambda x: x = t)) ** 2)))"
    return f"case when len({a}) = 0 or len({b}) = 0 then 0.0 else {dot} / ({norm(a)} * {norm(b)}) end"
