"""T operators: logical-form text cleaning as Column functions (no UDF).

Java regexes are not Unicode-aware by default while Python's are, so every
pattern with ``\\w`` / ``\\s`` carries the ``(?U)`` flag.  All functions take
and return Columns and therefore also work on streaming DataFrames.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from kgflow.sources.fixtures import INVERSE_PAIRS, RELATIONS

# Fixed patterns (reference semantics): entity mentions, relation lists and
# the two skeleton masks.
ENTITY_RE = r"(?U)\]\s?\)? \[ ([\s'\-\w]+) \] \)"
RELATION_RE = r"(?U)(?:R|JOIN) \[([\w,\s]+)\]"
SKELETON_JOIN_RE = r"(?U)\( JOIN \[[\w_\s'\-]+\] [\w+\"\\]+ \)"
SKELETON_BRACKET_RE = r"(?U)\[[\w_\s'\-]+\]"
RUN_ON_SEP = " ) ) ("


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def after_last(c, marker: str) -> Column:
    """Text after the last ``marker``; the whole text if it is absent."""
    return F.substring_index(_c(c), marker, -1)


def after_first(c, marker: str) -> Column:
    """The second piece of ``split(marker)`` (not the rest); null if absent."""
    c = _c(c)
    return F.when(F.instr(c, marker) > 0,
                  F.substring_index(F.substring_index(c, marker, 2), marker, -1))


def strip_wrapper(c) -> Column:
    """``strip('[]').strip('""')`` -- both are character sets."""
    return F.btrim(F.btrim(_c(c), F.lit("[]")), F.lit('"'))


def _count(c: Column, ch: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))


def clean_prediction(c) -> Column:
    """T4 in closed form.

    (a) a text ending ``)"]`` or ``)']`` loses its last two characters;
    (b) braces become brackets; (c) while the text ends with `` ) )`` and has
    more ``)`` than ``(``, the last two characters go.  The loop of (c) runs
    ``min(max(R - L, 0), max(k - 1, 0))`` times, k = trailing `` )`` units.
    """
    c = _c(c)
    n = F.length(c)
    a = F.when(c.endswith(')"]') | c.endswith(")']"), F.left(c, n - 2)).otherwise(c)
    b = F.translate(a, "{}", "[]")
    surplus = F.greatest(_count(b, ")") - _count(b, "("), F.lit(0))
    k = F.length(F.regexp_extract(b, r"((?: \))*)\z", 1)) / 2
    drop = F.least(surplus, F.greatest(k.cast("int") - 1, F.lit(0)))
    return F.left(b, F.length(b) - 2 * drop)


def split_predictions(c) -> Column:
    """T5: split run-on predictions on `` ) ) (``; every piece gets `` ) )``
    back (and ``(`` when it lacks one), then T4 removes the surplus."""
    parts = F.split(_c(c), re.escape(RUN_ON_SEP))
    return F.transform(parts, lambda x: clean_prediction(
        F.when(x.startswith("("), F.concat(x, F.lit(" ) )")))
        .otherwise(F.concat(F.lit("("), x, F.lit(" ) )")))))


def first_candidate(arr) -> Column:
    """Element 0 of T5."""
    return F.element_at(_c(arr), 1)


def entities(c) -> Column:
    """Entity mentions, in order, with repeats."""
    return F.regexp_extract_all(_c(c), F.lit(ENTITY_RE), 1)


def relations(c) -> Column:
    """Relation lists (items keep their surrounding spaces), in order."""
    return F.regexp_extract_all(_c(c), F.lit(RELATION_RE), 1)


def skeleton(c) -> Column:
    """Mask constrained joins, then every bracketed name."""
    s = F.regexp_replace(_c(c), SKELETON_JOIN_RE, "( JOIN [] )")
    return F.regexp_replace(s, SKELETON_BRACKET_RE, "[]")


def skeleton_list(arr) -> Column:
    return F.transform(_c(arr), skeleton)


def relations_list(arr) -> Column:
    return F.transform(_c(arr), relations)


def _alias_pairs() -> list[tuple[str, str]]:
    """Constrained-relation phrase -> its inverse phrase, built from the pairs:
    ``JOIN ( R [ r ] )`` <-> ``JOIN [ inv(r) ]``."""
    inv = {}
    for a, b in INVERSE_PAIRS:
        inv[a], inv[b] = b, a
    out = []
    for r in RELATIONS:
        out.append((f"JOIN ( R [ {r} ] )", f"JOIN [ {inv[r]} ]"))
        out.append((f"JOIN [ {r} ]", f"JOIN ( R [ {inv[r]} ] )"))
    return out


ALIASES = _alias_pairs()
_NAMES = "|".join(RELATIONS)
CONSTRAINED_RE = rf"JOIN \( R \[ (?:{_NAMES}) \] \)|JOIN \[ (?:{_NAMES}) \]"


def gold_aliases(c, max_swaps: int = 2) -> Column:
    """Equivalent forms under the inverse-relation pattern.

    A form with 1 to ``max_swaps`` constrained relations gives itself and every form with some of them
    swapped (in order: for each relation, all forms so far and then each with that relation replaced, all
    occurrences); a form with none or more gives [g] (the reference's rule, at 2).  The 20-entry alias
    map is a literal map expression.
    """
    g = _c(c)
    amap = F.create_map(*[F.lit(x) for kv in ALIASES for x in kv])
    rels = F.regexp_extract_all(g, F.lit(CONSTRAINED_RE), 0)
    swapped = F.aggregate(rels, F.array(g), lambda acc, r: F.concat(acc, F.transform(acc, lambda f: F.replace(f, r, F.element_at(amap, r)))))
    return F.when(F.size(rels) <= F.lit(max_swaps), swapped).otherwise(F.array(g))


def clean_lisp(c) -> Column:
    """``( ``->``(``, `` )``->``)``, drop ``[ `` and `` ]``, drop quotes."""
    s = _c(c)
    for a, b in (("( ", "("), (" )", ")"), ("[ ", ""), (" ]", ""), ("'", "")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def rewrite_mentions(c, mentions, ids, mode: str = "compat") -> Column:
    """Replace each mention by its KG id, in order.

    ``compat`` replaces the bare text everywhere (the reference's behaviour,
    which can rewrite inside earlier ids); ``bracketed`` replaces ``[ m ]``
    only."""
    z = F.arrays_zip(_c(mentions).alias("m"), _c(ids).alias("i"))
    if mode == "compat":
        step = lambda acc, e: F.replace(acc, e["m"], F.coalesce(e["i"], e["m"]))
    elif mode == "bracketed":
        step = lambda acc, e: F.replace(acc, F.concat(F.lit("[ "), e["m"], F.lit(" ]")),
                                        F.concat(F.lit("[ "), F.coalesce(e["i"], e["m"]), F.lit(" ]")))
    else:
        raise ValueError(mode)
    return F.aggregate(z, _c(c), step)


def aliases_long(df, key: str, aliases: str, pos: str = "pos", out: str = "alias"):
    """A wide alias list as a long table ``(key, pos, alias)`` (what the
    reference consumes row by row with ``p in g``)."""
    return df.select(key, F.posexplode(_c(aliases)).alias(pos, out))
