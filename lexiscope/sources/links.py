"""The identifier grammar of annotated corpora, compiled to column expressions.

A format is a list of (delimiter, relation, qualifiers allowed).  A string is split by the first format's
delimiter, each element by the remaining formats, and so on; the depth is at most the number of formats, so
the whole grammar unrolls into nested expressions.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexiscope.plans.frames import LEAF

NIL_RESOURCE = "<NIL>"


@dataclass(frozen=True)
class Grammar:
    """``formats``: (delimiter, relation, qualifiers allowed) from the outside in; ``qualifiers``: suffix or
    prefix -> match type, stripped before splitting; ``nil``: strings that stand for no concept."""

    formats: tuple[tuple[str, str, bool], ...] = ()
    qualifiers: dict[str, str] = field(default_factory=dict)
    nil: frozenset[str] = frozenset()
    resource: str | None = None
    delimiter: str | None = ":"


def _leaf(identifier: Column, resource: Column, match: Column) -> Column:
    return F.struct(identifier.cast("string").alias("identifier"), resource.cast("string").alias("resource"), match.cast("string").alias("match_type")).cast(LEAF)


def _atom(text: Column, grammar: Grammar, match: Column) -> Column:
    """One identifier: a nil label, resource and accession, or an accession of the default resource."""
    is_nil = text.isin(*sorted(grammar.nil)) if grammar.nil else F.lit(False)
    plain = _leaf(text, F.lit(grammar.resource), match)
    if grammar.delimiter:
        parts = F.split(text, "\\Q" + grammar.delimiter + "\\E")
        both = _leaf(F.get(parts, F.lit(1)), F.get(parts, F.lit(0)), match)
        bad = F.raise_error(F.concat(F.lit("identifier with several resource delimiters: "), text)).cast(LEAF)
        plain = F.when(F.size(parts) == 1, plain).when(F.size(parts) == 2, both).otherwise(bad)
    return F.when(is_nil, _leaf(F.lit(None), F.lit(NIL_RESOURCE), F.lit("NIL") if not grammar.formats else F.lit(None))).otherwise(plain)


def _qualified(text: Column, grammar: Grammar) -> tuple[Column, Column]:
    """The text without its longest matching qualifier, and that qualifier's match type (null if none)."""
    rest, match = F, F
    for q in sorted(grammar.qualifiers, key=len, reverse=True):
        hit = text.startswith(q) | text.endswith(q)
        cut = F.when(text.startswith(q), F.substr(text, F.lit(len(q) + 1))).otherwise(F.substr(text, F.lit(1), F.length(text) - len(q)))
        rest, match = rest.when(hit, F.trim(cut)), match.when(hit, F.lit(grammar.qualifiers[q]))
    if not grammar.qualifiers:
        return text, F.lit(None).cast("string")
    return rest.otherwise(text), match


def leaves(text: Column, grammar: Grammar, depth: int = 0, match: Column | None = None) -> Column:
    """All leaves of the link that ``text`` spells, in order.  A leaf's match type is the qualifier of the
    innermost string with one element; the qualifier of a string with several is the composite's."""
    match = F.lit(None).cast("string") if match is None else match
    if depth == len(grammar.formats):
        return F.array(_atom(F.trim(text), grammar, match))
    delimiter, _, allowed = grammar.formats[depth]
    rest, found = _qualified(F.trim(text), grammar) if allowed else (F.trim(text), F.lit(None).cast("string"))
    elements = F.split(rest, "\\Q" + delimiter + "\\E")
    own = F.when(F.size(elements) == 1, found)
    return F.flatten(F.transform(elements, lambda e: leaves(e, grammar, depth + 1, F.coalesce(own, match))))


def relations(text: Column, grammar: Grammar, depth: int = 0) -> Column:
    """The distinct relations of the composites in ``text``."""
    if depth == len(grammar.formats):
        return F.array().cast("array<string>")
    delimiter, relation, allowed = grammar.formats[depth]
    rest = _qualified(F.trim(text), grammar)[0] if allowed else F.trim(text)
    elements = F.split(rest, "\\Q" + delimiter + "\\E")
    inner = F.flatten(F.transform(elements, lambda e: relations(e, grammar, depth + 1)))
    own = F.when(F.size(elements) > 1, F.array(F.lit(relation))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(own, inner))


def link_key(text: Column, grammar: Grammar) -> Column:
    """A grouping key for the whole link: the relations and the leaves in order; null for no link."""
    spelled = F.transform(leaves(text, grammar), lambda x: F.concat_ws("|", F.coalesce(x["identifier"], F.lit("NIL")), x["resource"], x["match_type"]))
    return F.when(text.isNotNull(), F.concat(F.array_join(relations(text, grammar), ","), F.lit("("), F.array_join(spelled, ";"), F.lit(")")))
