"""DuckDB twins of the Column functions, as SQL text builders for the oracle.

RE2 (DuckDB) has no ``(?U)`` and an ASCII ``\\w``: patterns spell word
characters as ``\\p{L}\\p{N}_``.
"""

from __future__ import annotations

from kgflow.functions.forms import ALIASES, CONSTRAINED_RE

W = r"\p{L}\p{N}_"
ENTITY_RE_SQL = r"\]\s?\)? \[ ([\s''\-" + W + r"]+) \] \)"
RELATION_RE_SQL = r"(?:R|JOIN) \[([" + W + r",\s]+)\]"
SKEL1_SQL = r"\( JOIN \[[" + W + r"\s''\-]+\] [" + W + '+"' + r"\\]+ \)"
SKEL2_SQL = r"\[[" + W + r"\s''\-]+\]"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def after_last(e: str, m: str) -> str:
    return f"string_split({e}, {q(m)})[-1]"


def after_first(e: str, m: str) -> str:
    return f"case when strpos({e}, {q(m)}) > 0 then string_split({e}, {q(m)})[2] end"


def strip_wrapper(e: str) -> str:
    return f"trim(trim({e}, '[]'), '\"')"


def clean_prediction(e: str) -> str:
    a = f"(case when suffix({e}, ')\"]') or suffix({e}, ')'']') then left({e}, length({e}) - 2) else {e} end)"
    b = f"translate({a}, '{{}}', '[]')"
    surplus = f"greatest((length({b}) - length(replace({b}, ')', ''))) - (length({b}) - length(replace({b}, '(', ''))), 0)"
    k = f"(length(regexp_extract({b}, '((?: \\))*)$', 1)) // 2)"
    drop = f"least({surplus}, greatest({k} - 1, 0))"
    return f"left({b}, length({b}) - 2 * {drop})"


def split_predictions(e: str) -> str:
    piece = "case when starts_with(x, '(') then x || ' ) )' else '(' || x || ' ) )' end"
    return f"list_transform(string_split({e}, ' ) ) ('), lambda x: {clean_prediction('(' + piece + ')')})"


def entities(e: str) -> str:
    return f"regexp_extract_all({e}, '{ENTITY_RE_SQL}', 1)"


def relations(e: str) -> str:
    return f"regexp_extract_all({e}, '{RELATION_RE_SQL}', 1)"


def skeleton(e: str) -> str:
    return (f"regexp_replace(regexp_replace({e}, '{SKEL1_SQL}', '( JOIN [] )', 'g'), "
            f"'{SKEL2_SQL}', '[]', 'g')")


def alias_of(e: str) -> str:
    arms = " ".join(f"when {q(a)} then {q(b)}" for a, b in ALIASES)
    return f"(case {e} {arms} end)"


def gold_aliases(e: str) -> str:
    rels = f"regexp_extract_all({e}, {q(CONSTRAINED_RE)}, 0)"
    r1, r2 = f"{rels}[1]", f"{rels}[2]"
    s1 = f"replace({e}, {r1}, {alias_of(r1)})"
    s2 = f"replace({e}, {r2}, {alias_of(r2)})"
    both = f"replace({s1}, {r2}, {alias_of(r2)})"
    n = f"len({rels})"
    return f"(case when {n} = 1 then [{e}, {s1}] when {n} = 2 then [{e}, {s1}, {s2}, {both}] else [{e}] end)"


def clean_lisp(e: str) -> str:
    s = e
    for a, b in (("( ", "("), (" )", ")"), ("[ ", ""), (" ]", ""), ("'", "")):
        s = f"replace({s}, {q(a)}, {q(b)})"
    return s


def split_ws(e: str) -> str:
    return f"list_filter(string_split(trim(regexp_replace({e}, '\\s+', ' ', 'g')), ' '), lambda t: t <> '')"


def tok13a(e: str) -> str:
    s = e
    for a, b in (("<skipped>", ""), ("-\n", ""), ("\n", " "), ("&quot;", '"'), ("&amp;", "&"),
                 ("&lt;", "<"), ("&gt;", ">")):
        s = f"replace({s}, {q(a)}, {q(b)})"
    s = f"(' ' || {s} || ' ')"
    rules = [(r"([{-~\[-\x60 -&(-+:-@/])", r" \1 "), (r"([^0-9])([.,])", r"\1 \2 "),
             (r"([.,])([^0-9])", r" \1 \2"), (r"([0-9])(-)", r"\1 \2 ")]
    for pat, rep in rules:
        s = f"regexp_replace({s}, {q(pat)}, {q(rep)}, 'g')"
    return split_ws(s)


def tok_rouge(e: str) -> str:
    return split_ws(f"regexp_replace(lower({e}), '[^a-z0-9]+', ' ', 'g')")


def bleu_sql(rows_cte: str, max_order: int = 4, by: str | None = None, detail: bool = False) -> str:
    """Corpus BLEU over a CTE body with columns (id, pred, refs list[, run])."""
    b = f"{by}, " if by else ""
    g = f"group by {by}" if by else ""
    j = f"using ({by})" if by else "on true"
    orders = range(1, max_order + 1)
    sums_m = ", ".join(f"sum(case when n = {k} then m end) as m{k}" for k in orders)
    sums_p = ", ".join(f"sum(greatest(tl - {k - 1}, 0)) as poss{k}" for k in orders)
    prec = ", ".join(f"case when poss{k} > 0 then coalesce(m{k}, 0) / poss{k} else 0.0 end as precision_{k}"
                     for k in orders)
    least = "least(" + ", ".join(f"precision_{k}" for k in orders) + ")"
    geo = f"case when {least} > 0 then exp((" + " + ".join(f"ln(precision_{k})" for k in orders) + f") / {max_order}) else 0.0 end"
    ngr = ("list_concat(" + ", ".join(
        f"list_transform(range(1, len(TOK) - {n} + 2), lambda i: {{'n': {n}, 'g': array_to_string(TOK[i:i + {n - 1}], ' ')}})"
        for n in orders) + ")")
    extra = (", " + ", ".join(f"precision_{k}" for k in orders)
             + ", brevity_penalty, length_ratio, translation_length, reference_length") if detail else ""
    return f"""
with rows as ({rows_cte}),
tok as (select {b}id, {tok13a('pred')} as pt, list_transform(refs, lambda r: {tok13a('r')}) as rts from rows),
pn as (select {b}id, ng.n as n, ng.g as g, count(*) as c from (select {b}id, unnest({ngr.replace('TOK', 'pt')}) as ng from tok) group by all),
rl as (select {b}id, j, unnest({ngr.replace('TOK', 'rt')}) as ng from (select {b}id, generate_subscripts(rts, 1) as j, unnest(rts) as rt from tok)),
rn as (select {b}id, n, g, max(c) as rc from (select {b}id, j, ng.n as n, ng.g as g, count(*) as c from rl group by all) group by all),
cl as (select pn.*, least(pn.c, coalesce(rn.rc, 0)) as m from pn left join rn using ({b}id, n, g)),
mt as (select {b}{sums_m} from cl {g}),
tt as (select {b}cast(sum(len(pt)) as bigint) as translation_length,
       cast(sum(coalesce(list_min(list_transform(rts, lambda r: len(r))), 0)) as bigint) as reference_length,
       {sums_p} from (select {b}pt, rts, len(pt) as tl from tok) {g}),
pr as (select {b}translation_length, reference_length, {prec} from tt join mt {j}),
fin as (select *, translation_length::double / reference_length as length_ratio,
        case when translation_length::double / reference_length > 1.0 then 1.0
             else exp(1 - reference_length::double / translation_length) end as brevity_penalty from pr)
select {b}brevity_penalty * {geo} as bleu{extra} from fin
"""


def rouge_n_sql(rows_cte: str, orders=(1, 2)) -> str:
    """Per-row best-reference ROUGE-N F1, averaged, in percent (4 decimals)."""
    mx = max(orders)
    ngr = ("list_concat(" + ", ".join(
        f"list_transform(range(1, len(TOK) - {n} + 2), lambda i: {{'n': {n}, 'g': array_to_string(TOK[i:i + {n - 1}], ' ')}})"
        for n in range(1, mx + 1)) + ")")
    olist = ", ".join(str(n) for n in orders)
    piv = ", ".join(f"round(avg(coalesce(max_f{n}, 0.0)) * 100, 4) as rouge{n}" for n in orders)
    per = ", ".join(f"max(case when n = {n} then f end) as max_f{n}" for n in orders)
    return f"""
with rows as ({rows_cte}),
tok as (select id, {tok_rouge('pred')} as pt, list_transform(refs, lambda r: {tok_rouge('r')}) as rts from rows),
rr as (select id, pt, generate_subscripts(rts, 1) as j, unnest(rts) as rt from tok),
pairs as (select id, j, n, greatest(len(pt) - n + 1, 0) as tp, greatest(len(rt) - n + 1, 0) as tr
          from rr cross join (select unnest([{olist}]) as n)),
pn as (select id, ng.n as n, ng.g as g, count(*) as c from (select id, unnest({ngr.replace('TOK', 'pt')}) as ng from tok) group by all),
rn as (select id, j, ng.n as n, ng.g as g, count(*) as cr from (select id, j, unnest({ngr.replace('TOK', 'rt')}) as ng from rr) group by all),
ov as (select id, j, n, sum(least(c, cr)) as ov from pn join rn using (id, n, g) group by all),
sc as (select id, j, n, coalesce(ov, 0) / greatest(tp, 1) as p, coalesce(ov, 0) / greatest(tr, 1) as r
       from pairs left join ov using (id, j, n)),
f as (select id, n, max(case when p + r > 0 then 2 * p * r / (p + r) else 0.0 end) as f from sc group by all),
w as (select id, {per} from f group by id)
select {piv} from w
"""


def rouge_l_sql(rows_cte: str) -> str:
    """Per-row ROUGE-L F1 of the best reference.  One recursion step per reference token: row i of the
    table of longest common subsequences is the running maximum of (cell above-left + 1 where the tokens are equal,
    else cell above)."""
    return f"""
with recursive rows as ({rows_cte}),
tok as (select id, {tok_rouge('pred')} as pt, generate_subscripts(refs, 1) as j, unnest(list_transform(refs, lambda r: {tok_rouge('r')})) as rt from rows),
l as (select id, j, 0 as i, list_transform(pt, lambda x: 0) as v from tok
      union all
      select id, j, i + 1, list_transform(range(1, len(c) + 1), lambda k: list_max(c[1:k]))
      from (select l.id, l.j, l.i, list_transform(range(1, len(pt) + 1), lambda k: case when pt[k] = rt[i + 1] then coalesce(v[k - 1], 0) + 1 else v[k] end) as c
            from l join tok using (id, j) where l.i < len(tok.rt))),
s as (select id, coalesce(v[len(pt)], 0) / greatest(len(pt), 1) as p, coalesce(v[len(pt)], 0) / greatest(len(rt), 1) as r from l join tok using (id, j) where l.i = len(tok.rt))
select id, round(max(case when p + r > 0 then 2 * p * r / (p + r) else 0.0 end), 12) as rouge_l from s group by id
"""


def _sentences(e: str) -> str:
    lines = f"string_split(regexp_replace(lower({e}), '[^a-z0-9\\n]+', ' ', 'g'), chr(10))"
    return f"list_filter(list_transform({lines}, lambda x: {split_ws('x')}), lambda t: len(t) > 0)"


def rouge_l_summary_sql(rows_cte: str) -> str:
    """Mean ROUGE-L and ROUGE-Lsum F1 in percent.  For Lsum every reference sentence meets every prediction sentence: a table of common
    subsequences row by row, then the way back through it; the places found in a reference sentence are united over the prediction's sentences, and a token counts at
    most as often as the prediction has it."""
    return f"""
with recursive rows as ({rows_cte}),
texts as (select id, coalesce(pred, '') as pred, generate_subscripts(refs, 1) as j, unnest(refs) as ref from rows),
ps as (select id, generate_subscripts(s, 1) as l, unnest(s) as pt from (select id, {_sentences("coalesce(pred, '')")} as s from rows)),
rs as (select id, j, generate_subscripts(s, 1) as k, unnest(s) as rt from (select id, j, {_sentences('ref')} as s from texts)),
pairs as materialized (select row_number() over () as q, id, j, k, rt, pt from rs join ps using (id)),
l as (select q, 0 as i, list_transform(pt, lambda x: 0) as v from pairs
      union all
      select q, i + 1, list_transform(range(1, len(c) + 1), lambda n: list_max(c[1:n]))
      from (select l.q, l.i, list_transform(range(1, len(pt) + 1), lambda n: case when pt[n] = rt[i + 1] then coalesce(v[n - 1], 0) + 1 else v[n] end) as c
            from l join pairs using (q) where l.i < len(rt))),
w as (select q, len(rt) as i, len(pt) as n, 0 as hit from pairs
      union all
      select w.q, case when rt[w.i] = pt[w.n] or b.v[w.n] = a.v[w.n] then w.i - 1 else w.i end,
        case when rt[w.i] = pt[w.n] or b.v[w.n] <> a.v[w.n] then w.n - 1 else w.n end, case when rt[w.i] = pt[w.n] then w.i else 0 end
      from w join pairs using (q) join l a on a.q = w.q and a.i = w.i join l b on b.q = w.q and b.i = w.i - 1 where w.i > 0 and w.n > 0),
places as (select distinct id, j, k, hit, rt[hit] as tok from w join pairs using (q) where hit > 0),
united as (select id, j, tok, count(*) as c from places group by all),
had as (select id, tok, count(*) as c from (select id, unnest(pt) as tok from ps) group by all),
hits as (select id, j, sum(least(united.c, had.c)) as h from united join had using (id, tok) group by all),
np as (select id, sum(len(pt)) as n from ps group by id),
nr as (select id, j, sum(len(rt)) as n from rs group by all),
f as (select id, j, 2 * (h / np.n) * (h / nr.n) / (h / np.n + h / nr.n) as f from hits join np using (id) join nr using (id, j)),
best as (select id, max(f) as f from f group by id),
one as ({rouge_l_sql(rows_cte)})
select round(avg(one.rouge_l) * 100, 4) as "rougeL", round(avg(coalesce(best.f, 0)) * 100, 4) as "rougeLsum" from one left join best using (id)"""
