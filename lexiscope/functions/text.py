"""Column functions over text and identifiers; everything here stays inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
SENTENCE = r"[^.!?]+[.!?]*"


def tokens(text: Column) -> Column:
    """Lower-cased words; underscores separate.  Null gives an empty array."""
    return F.regexp_extract_all(F.lower(F.translate(F.coalesce(text, F.lit("")), "_", " ")), F.lit(WORD), F.lit(0))


def sentences(text: Column) -> Column:
    """Trimmed, non-empty runs up to closing punctuation (a rule, not a trained splitter)."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SENTENCE), F.lit(0))
    return F.filter(F.transform(found, lambda s: F.trim(F.regexp_replace(s, r"^\s+|\s+$", ""))), lambda s: s != "")


def clean(text: Column) -> Column:
    """White space collapsed and trimmed; null if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(""))


def dedupe(strings: Column) -> Column:
    """Cleaned strings, each once, in the order of first appearance."""
    return F.array_distinct(F.filter(F.transform(strings, clean), lambda s: s.isNotNull()))


def folded(text: Column) -> Column:
    """White space collapsed, trimmed, lower case: the form in which names are compared."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def resource_key(text: Column) -> Column:
    """Lower case without anything but a-z and 0-9; null for blank."""
    return F.nullif(F.regexp_replace(F.lower(text), "[^a-z0-9]+", ""), F.lit(""))


def journal_key(text: Column) -> Column:
    """Punctuation and underscores as single spaces, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " ")))


def corpus_key(text: Column) -> Column:
    """Lower case, one trailing _corpus, _train, _test or _dev cut off, letters and digits only."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "_(corpus|train|test|dev)$", ""), "[^a-z0-9]+", "")


def concept_key(text: Column) -> Column:
    """Trimmed, with colons for underscores."""
    return F.translate(F.trim(text), "_", ":")


def iri_concept(text: Column) -> Column:
    """The part behind the last slash and then the last hash, with colons for underscores."""
    return F.translate(F.regexp_replace(F.regexp_replace(text, "^.*/", ""), "^.*#", ""), "_", ":")


def parent_tree_number(tree: Column) -> Column:
    """The tree number without its last segment; null at the top."""
    return F.when(F.instr(tree, ".") > 0, F.regexp_replace(tree, r"\.[^.]+$", ""))


def tree_prefixes(tree: Column) -> Column:
    """All dotted prefixes from the whole number up: a.b.c, a.b, a."""
    parts = F.split(tree, r"\.")
    return F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "."))


def normal_identifier(kind: Column, value: Column) -> Column:
    """A pmid, pmcid or doi in its normal form; null if it isn't one."""
    v = F.trim(value)
    pmcid = F.upper(v)
    pmcid = F.when(pmcid.rlike("^[0-9]+$"), F.concat(F.lit("PMC"), pmcid)).otherwise(pmcid)
    doi = F.regexp_replace(F.lower(v), r"^(https?://(dx\.)?doi\.org/|doi:\s*)", "")
    return (
        F.when((kind == "pmid") & v.rlike("^[0-9]+$"), v)
        .when((kind == "pmcid") & pmcid.rlike("^PMC"), pmcid)
        .when((kind == "doi") & (doi != ""), doi)
    )


def issn(value: Column) -> Column:
    """Eight characters without hyphens and spaces, upper case; null otherwise."""
    plain = F.upper(F.regexp_replace(value, "[- ]", ""))
    return F.when(F.length(plain) == 8, plain)


def as_bool(text: str) -> bool:
    """y, yes, t, true, on, 1 and their opposites, whatever the case; anything else is an error."""
    value = text.strip().lower()
    if value in {"y", "yes", "t", "true", "on", "1"}:
        return True
    if value in {"n", "no", "f", "false", "off", "0"}:
        return False
    raise ValueError(f"not a truth value: {text!r}")
