"""String expressions: regular-expression chains, words, sentences, and bag-of-words similarity."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from . import rules

SPACE = r"[\s\p{Z}]"
_Wordish = r"[\p{L}\p{N}_]"


def chain(text: Column, steps: list[tuple[str, str]]) -> Column:
    """Each (pattern, replacement) in turn, all matches; ``\\1`` in a replacement is a group."""
    for pattern, new in steps:
        new = re.sub(r"\\(\d)", "\0\\1", new).replace("\\", "\\\\").replace("$", "\\$").replace("\0", "$")
        text = F.regexp_replace(text, F.lit(pattern), F.lit(new))
    return text


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+\z", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, rf"{SPACE}+\z", "")


def nz(text: Column) -> Column:
    """Null text is empty."""
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    """Runs without white space."""
    return F.regexp_extract_all(nz(text), F.lit(r"[^\s\p{Z}]+"), F.lit(0))


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(nz(text)), F.lit(_Wordish + "+"), F.lit(0))


def blank(text: Column) -> Column:
    return strip(nz(text)) == ""


def capitalise(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 2_000_000_000))


def snippet(text: Column, n: int) -> Column:
    """The first ``n`` characters, and "…" if there are more."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


def count_of(text: Column, part: str) -> Column:
    """Non-overlapping occurrences of a fixed string."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def fill(phrase: str, value: Column) -> Column:
    """``phrase`` with ``value`` in place of its first {}."""
    head, tail = phrase.split("{}", 1)
    return F.concat(F.lit(head), value, F.lit(tail))


def let(value: Column, fn) -> Column:
    """``fn`` of ``value``, computed once: a name inside a lambda is a variable, while an expression would be computed for each element."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def _counts(bag: Column) -> Column:
    """array<struct<t, n>> by term: the bag is sorted, and where a term first stands and the next one does gives its count."""

    def runs(sorted_: Column) -> Column:
        n = F.size(sorted_)
        first = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.element_at(sorted_, i) != F.element_at(sorted_, F.greatest(i - 1, F.lit(1)))))
        count = lambda p: F.transform(p, lambda i, k: F.struct(F.element_at(sorted_, i).alias("t"), (F.coalesce(F.get(p, k + 1), n + 1) - i).cast("double").alias("n")))
        return F.when(n > 0, let(first, count)).otherwise(F.array().cast("array<struct<t:string,n:double>>"))

    return let(F.array_sort(bag), runs)


def _norm(counts: Column) -> Column:
    return F.sqrt(F.aggregate(counts, F.lit(0.0), lambda a, x: a + x["n"] * x["n"]))


def term_counts(bag: Column) -> Column:
    """array<struct<t, n>>, by term."""
    return _counts(bag)


def bag_norm(bag: Column) -> Column:
    return _norm(term_counts(bag))


def bag_cosine(a: Column, b: Column) -> Column:
    """Cosine of two token arrays as term-count vectors; 0 if either is empty. The counts of both are sorted together, so that equal terms
    stand side by side: linear in the texts but for the sort."""

    def dot(both: Column) -> Column:
        pair = lambda i: F.when(F.element_at(both, i)["t"] == F.element_at(both, i - 1)["t"], F.element_at(both, i)["n"] * F.element_at(both, i - 1)["n"]).otherwise(F.lit(0.0))
        return F.aggregate(F.sequence(F.lit(2), F.size(both)), F.lit(0.0), lambda s, i: s + pair(i))

    def of(p: Column) -> Column:
        full = (F.size(p["a"]) > 0) & (F.size(p["b"]) > 0)
        return F.when(full, let(F.array_sort(F.concat(p["a"], p["b"])), dot) / (_norm(p["a"]) * _norm(p["b"]))).otherwise(F.lit(0.0))

    return let(F.struct(_counts(a).alias("a"), _counts(b).alias("b")), of)


# ---- corpus cleaning ----


def clean_corpus(text: Column) -> Column:
    return strip(chain(text, rules.CONTROL))


def normalize_for_chunking(text: Column) -> Column:
    return strip(chain(text, rules.CHUNK_NORMAL))


def html_to_text(text: Column) -> Column:
    return chain(text, rules.HTML_TAGS)


def html_main_text(text: Column) -> Column:
    """Comments and the dropped elements go, tags become spaces, entities characters. An approximation of a parser."""
    steps = [(r"(?s)<!--.*?-->", "")] + [(rf"(?is)<{t}\b[^>]*>.*?</{t}\s*>", "") for t in rules.HTML_DROPPED] + [(r"<[^>]+>", " ")]
    out = chain(text, steps)
    for entity, char in rules.HTML_ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def strip_markdown(text: Column) -> Column:
    return chain(text, rules.MARKDOWN)


def clean_instruction(text: Column) -> Column:
    return strip(chain(nz(text), rules.INSTRUCTION))


def redact_email(text: Column) -> Column:
    return chain(text, [(rules.EMAIL, "[EMAIL]")])


def email_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(rules.EMAIL))


#: White space behind . ? or ! unless an abbreviation stands there.
SENTENCE_END = r"(?<![\p{L}\p{N}_]\.[\p{L}\p{N}_].)(?<![A-Z][a-z]\.)(?<=\.|\?|!)[\s\p{Z}]"


def sentences(text: Column) -> Column:
    """Split at white space behind . ? or ! unless an abbreviation stands there; trimmed, blanks dropped."""
    parts = F.split(nz(text), SENTENCE_END)
    return F.filter(F.transform(parts, strip), lambda s: s != "")
