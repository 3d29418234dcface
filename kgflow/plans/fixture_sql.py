"""DuckDB twins of the Spark fixture builders (``kgflow.sources.fixtures``).

The oracle of every query starts from these CTEs, so both engines see the
same rows.  Dates are ``YYYY-MM-DD`` text and money integer cents, because
double-to-string differs between engines.
"""

TRIPLES_SQL = """
select concat('reg_', r_regionkey) s, 'type.object.type' p, 'Region' o, 'iri' o_kind, '' o_datatype, '' o_lang from region
union all select concat('nat_', n_nationkey), 'type.object.type', 'Nation', 'iri', '', '' from nation
union all select concat('cust_', c_custkey), 'type.object.type', 'Customer', 'iri', '', '' from customer
union all select concat('supp_', s_suppkey), 'type.object.type', 'Supplier', 'iri', '', '' from supplier
union all select concat('part_', p_partkey), 'type.object.type', 'Part', 'iri', '', '' from part
union all select concat('ord_', o_orderkey), 'type.object.type', 'Order', 'iri', '', '' from orders
union all select concat('nat_', n_nationkey), 'in_region', concat('reg_', n_regionkey), 'iri', '', '' from nation
union all select concat('cust_', c_custkey), 'in_nation', concat('nat_', c_nationkey), 'iri', '', '' from customer
union all select concat('supp_', s_suppkey), 'in_nation', concat('nat_', s_nationkey), 'iri', '', '' from supplier
union all select concat('ord_', o_orderkey), 'placed_by', concat('cust_', o_custkey), 'iri', '', '' from orders
union all select distinct concat('ord_', l_orderkey), 'contains', concat('part_', l_partkey), 'iri', '', '' from lineitem
union all select distinct concat('part_', l_partkey), 'supplied_by', concat('supp_', l_suppkey), 'iri', '', '' from lineitem
union all select concat('ord_', o_orderkey), 'total_price', cast(cast(round(o_totalprice * 100) as bigint) as varchar), 'literal', 'integer', '' from orders
union all select concat('ord_', o_orderkey), 'order_date', cast(cast(o_orderdate as date) as varchar), 'literal', 'date', '' from orders
union all select concat('ord_', o_orderkey), 'status', o_orderstatus, 'literal', '', '' from orders
union all select concat('part_', p_partkey), 'label', p_name, 'literal', '', case p_partkey % 3 when 0 then 'en' when 1 then 'fi' else '' end from part
union all select concat('cust_', o_custkey), 'active.from', cast(cast(min(o_orderdate) as date) as varchar), 'literal', 'date', ''
  from orders where o_custkey in (select c_custkey from customer where c_acctbal >= 0) group by o_custkey
union all select concat('cust_', o_custkey), 'active.to', cast(cast(max(o_orderdate) as date) as varchar), 'literal', 'date', ''
  from orders where o_custkey in (select c_custkey from customer where c_mktsegment <> 'BUILDING') group by o_custkey
"""


def with_triples(body: str) -> str:
    return f"with triples as ({TRIPLES_SQL})\n{body}"


def _cycle_sql(expr: str) -> str:
    names = ["requirement", "required_for", "services", "services_by", "target_group", "target_group_for",
             "issued_by", "issues", "eligible_for", "target_group_for_document"]
    arms = " ".join(f"when {i} then '{n}'" for i, n in enumerate(names))
    return f"case ({expr}) % 10 {arms} end"


def _inv_sql(expr: str) -> str:
    pairs = [("requirement", "required_for"), ("services", "services_by"), ("target_group", "target_group_for"),
             ("issued_by", "issues"), ("eligible_for", "target_group_for_document")]
    arms = " ".join(f"when '{a}' then '{b}' when '{b}' then '{a}'" for a, b in pairs)
    return f"case {expr} {arms} end"


def _form_sql(join: str) -> str:
    return (f"case when p_size > 25 then '( AND [ Document ] ( AND ' || {join} || ' ( JOIN [ issued_by ] [ ' || lower(p_type) || ' ] ) ) )'"
            f" else '( AND [ Document ] ' || {join} || ' )' end")


FORMS_SQL = f"""
select p_partkey as idx, 'which document covers ' || p_name || '?' as question, gold,
  case p_partkey % 6 when 0 then gold when 1 then gold || ' ) )' when 2 then translate(gold, '[]', '{{}}')
    when 3 then swap when 4 then '[''user assistant' || gold || ''']' else wrong end as raw_pred
from (select p_partkey, p_name,
  {_form_sql("'( JOIN ( R [ ' || " + _cycle_sql("p_partkey") + " || ' ] ) [ ' || p_name || ' ] )'")} as gold,
  {_form_sql("'( JOIN [ ' || " + _inv_sql(_cycle_sql("p_partkey")) + " || ' ] [ ' || p_name || ' ] )'")} as swap,
  {_form_sql("'( JOIN ( R [ ' || " + _cycle_sql("p_partkey + 3") + " || ' ] ) [ ' || p_name || ' ] )'")} as wrong
  from part)
"""

TEXT_PAIRS_SQL = """
select u.conv_id, u.turn, u.text as gold, a.text as pred from conversations u
left join conversations a on u.conv_id = a.conv_id and a.turn = u.turn + 1 and a.role = 'assistant'
where u.role = 'user'
"""

TRAINING_SQL = """
select d.doc_id as idx, d.text as input, 'quality ' || l.quality || ' toxic ' || l.toxic as output
from documents d join labels l on d.doc_id = l.doc_id
"""

TOKENS_SQL = """
select user_id, event_id, case when value < 10 then -100 else cast(floor(value) as int) end as token_id from events
"""

QNODES_SQL = """
select o_orderkey as qid, cast(case when k.n = 4 then 4 when o_orderkey % 2 = 0 then k.n else 4 - k.n end as bigint) as nid,
  case k.n when 1 then 'Order' when 3 then o_orderstatus else 'cust_' || (o_custkey % 5) end as id,
  case k.n when 1 then 'class' when 3 then 'literal' else 'entity' end as type,
  case when k.n = 1 then 1 else 0 end as question, 'none' as function
from orders join (select unnest([1, 2, 3, 4]) as n) k on k.n < 4 or o_orderpriority = '1-URGENT'
"""

QEDGES_SQL = """
select o_orderkey as qid, cast(case when o_orderkey % 2 = 0 then 1 else 3 end as bigint) as src,
  cast(case when k.n = 3 then (case when o_orderkey % 2 = 0 then 3 else 1 end) else k.n end as bigint) as dst,
  case when k.n = 3 then 'status' else 'placed_by' end as relation
from orders join (select unnest([2, 3, 4]) as n) k on k.n < 4 or o_orderpriority = '1-URGENT'
"""
