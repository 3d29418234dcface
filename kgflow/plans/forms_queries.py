"""Corpus cleaning, scoring and preparation queries (T, M, P operators) over
the fixtures F2 (forms), F4 (text pairs), F5 (training pairs), F7 (tokens)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgflow.functions import forms as T
from kgflow.functions import prep as P
from kgflow.functions import score as M
from kgflow.plans import sql_text as S
from kgflow.plans.fixture_sql import FORMS_SQL, TEXT_PAIRS_SQL, TOKENS_SQL, TRAINING_SQL
from kgflow.sources.fixtures import qa_forms, text_pairs, token_ids, training_pairs_fixture
from kgflow.sources.tables import Tables

MARKER = "assistant"
DIGITS = 12          # exp/log outputs are rounded: JVM and DuckDB may differ in the last bit
SEP = " | "
PAD_ID = 0
DEV_SHARE = 0.2
SPLIT_SEED = "7"
TEMPLATE = "Generate a Logical Form query for the question.\n{{input}}\nAnswer: {{output}}"
DEF_TEMPLATE = "Text: <QUESTION>\nDefine <ENTITY> using the text. Answer:"


def _forms(spark, sf) -> DataFrame:
    return qa_forms(Tables(spark, sf))


def _cleaned(spark, sf) -> DataFrame:
    """T1 -> T4 -> T10: the prediction after the chat marker, cleaned, with the
    gold's inverse-relation aliases."""
    f = _forms(spark, sf)
    return f.select("idx", T.clean_prediction(T.after_last("raw_pred", MARKER)).alias("pred"),
                    T.gold_aliases("gold").alias("golds"))


def _cleaned_sql() -> str:
    return (f"select idx, {S.clean_prediction(S.after_last('raw_pred', MARKER))} as pred, "
            f"{S.gold_aliases('gold')} as golds from ({FORMS_SQL})")


def forms_after_last(spark, sf):
    """T1."""
    return _forms(spark, sf).select("idx", T.after_last("raw_pred", MARKER).alias("pred"))


SQL_AFTER_LAST = f"select idx, {S.after_last('raw_pred', MARKER)} as pred from ({FORMS_SQL})"


def forms_after_first(spark, sf):
    """T2 (null where the marker is absent)."""
    return _forms(spark, sf).select("idx", T.after_first("raw_pred", MARKER).alias("pred"))


SQL_AFTER_FIRST = f"select idx, {S.after_first('raw_pred', MARKER)} as pred from ({FORMS_SQL})"


def forms_strip_wrapper(spark, sf):
    """T3."""
    return _forms(spark, sf).select("idx", T.strip_wrapper("raw_pred").alias("pred"))


SQL_STRIP_WRAPPER = f"select idx, {S.strip_wrapper('raw_pred')} as pred from ({FORMS_SQL})"


def forms_clean(spark, sf):
    """T1 -> T4."""
    return _forms(spark, sf).select("idx", T.clean_prediction(T.after_last("raw_pred", MARKER)).alias("pred"))


SQL_CLEAN = f"select idx, {S.clean_prediction(S.after_last('raw_pred', MARKER))} as pred from ({FORMS_SQL})"


def forms_split(spark, sf):
    """T5 -> T6 over the raw output with the gold appended as a run-on second
    candidate (``pred ) ) ( gold``)."""
    f = _forms(spark, sf)
    runon = F.concat(T.after_last("raw_pred", MARKER), F.lit(" ) ) ("), F.col("gold"))
    parts = T.split_predictions(runon)
    return f.select("idx", F.array_join(parts, SEP).alias("parts"), T.first_candidate(parts).alias("first"),
                    F.size(parts).cast("bigint").alias("n_parts"))


_RUNON = f"({S.after_last('raw_pred', MARKER)} || ' ) ) (' || gold)"
SQL_SPLIT = f"""select idx, array_to_string(sp, '{SEP}') as parts, sp[1] as first, cast(len(sp) as bigint) as n_parts
from (select idx, {S.split_predictions(_RUNON)} as sp from ({FORMS_SQL}))"""


def forms_entities(spark, sf):
    """Mentions of every gold form."""
    e = T.entities("gold")
    return _forms(spark, sf).select("idx", F.array_join(e, SEP).alias("mentions"), F.size(e).cast("bigint").alias("n"))


SQL_ENTITIES = f"""select idx, array_to_string(e, '{SEP}') as mentions, cast(len(e) as bigint) as n
from (select idx, {S.entities('gold')} as e from ({FORMS_SQL}))"""


def forms_relations(spark, sf):
    """Relation lists of the raw predictions."""
    r = T.relations("raw_pred")
    return _forms(spark, sf).select("idx", F.array_join(r, SEP).alias("rels"), F.size(r).cast("bigint").alias("n"))


SQL_RELATIONS = f"""select idx, array_to_string(r, '{SEP}') as rels, cast(len(r) as bigint) as n
from (select idx, {S.relations('raw_pred')} as r from ({FORMS_SQL}))"""


def forms_skeleton(spark, sf):
    """Skeletons of gold and raw prediction."""
    return _forms(spark, sf).select("idx", T.skeleton("gold").alias("gold_skel"), T.skeleton("raw_pred").alias("pred_skel"))


SQL_SKELETON = f"select idx, {S.skeleton('gold')} as gold_skel, {S.skeleton('raw_pred')} as pred_skel from ({FORMS_SQL})"


def forms_gold_aliases(spark, sf):
    """T10 -> T13: the alias list as a long table (one row per alternative)."""
    f = _forms(spark, sf).select("idx", T.gold_aliases("gold").alias("golds"))
    return T.aliases_long(f, "idx", "golds").select("idx", F.col("pos").cast("bigint").alias("pos"), "alias")


SQL_GOLD_ALIASES = f"""select idx, cast(generate_subscripts(a, 1) - 1 as bigint) as pos, unnest(a) as alias
from (select idx, {S.gold_aliases('gold')} as a from ({FORMS_SQL}))"""


def forms_clean_lisp(spark, sf):
    """T11."""
    return _forms(spark, sf).select("idx", T.clean_lisp("gold").alias("lisp"))


SQL_CLEAN_LISP = f"select idx, {S.clean_lisp('gold')} as lisp from ({FORMS_SQL})"


def forms_mentions_rewrite(spark, sf):
    """Flagship T7 -> T12 -> T11: mentions replaced by a content id, in order
    (compat mode), then the form normalised."""
    f = _forms(spark, sf)
    e = T.entities("gold")
    ids = F.transform(e, lambda m: F.concat(F.lit("ent_"), F.substring(F.md5(m), 1, 8)))
    return f.select("idx", T.clean_lisp(T.rewrite_mentions("gold", e, ids)).alias("lisp"))


SQL_MENTIONS_REWRITE = f"""select idx, {S.clean_lisp("list_reduce(list_zip(e, ids), lambda acc, z: replace(acc, z[1], z[2]), gold)")} as lisp
from (select idx, gold, e, list_transform(e, lambda m: 'ent_' || substr(md5(m), 1, 8)) as ids
      from (select idx, gold, {S.entities('gold')} as e from ({FORMS_SQL})))"""


def forms_match_rates(spark, sf):
    """M1, M2, M3 on the cleaned predictions."""
    c = _cleaned(spark, sf)
    return c.agg(M._ratio(M.exact_hit("pred", "golds")).alias("accuracy"),
                 M._ratio(M.skeleton_hit("pred", "golds")).alias("skeleton_match"),
                 M._ratio(M.relation_hit("pred", "golds")).alias("relation_match"))


_RATES = f"""avg(case when list_contains(golds, pred) then 1.0 else 0.0 end) as accuracy,
  avg(case when list_contains(list_transform(golds, lambda g: {S.skeleton('g')}), {S.skeleton('pred')}) then 1.0 else 0.0 end) as skeleton_match,
  avg(case when list_contains(list_transform(golds, lambda g: {S.relations('g')}), {S.relations('pred')}) then 1.0 else 0.0 end) as relation_match"""
SQL_MATCH_RATES = f"select {_RATES} from ({_cleaned_sql()})"


def forms_clean_score(spark, sf):
    """Flagship T1 -> T4 -> T10 -> M11: accuracy, BLEU, skeleton and relation match."""
    c = _cleaned(spark, sf)
    r = M.score_run(c, "pred", "golds")
    return r.withColumn("bleu", F.round("bleu", DIGITS))


SQL_CLEAN_SCORE = f"""select r.accuracy, r.skeleton_match, r.relation_match, round(b.bleu, {12}) as bleu
from (select {_RATES} from ({_cleaned_sql()})) r,
({S.bleu_sql(f"select idx as id, pred, golds as refs from ({_cleaned_sql()})")}) b"""


def retrieval_report(spark, sf):
    """M11, retrieval form: accuracy, BLEU with its parts, ROUGE-1 and -2 of the cleaned forms in one pass."""
    b = M.score_retrieval(_cleaned(spark, sf), "pred", "golds", lcs=False)
    return b.withColumns({c: F.round(c, DIGITS) for c in ("bleu", "brevity_penalty")})


SQL_RETRIEVAL = f"""select r.accuracy, g.rouge1, g.rouge2, b.* replace (round(b.bleu, 12) as bleu, round(b.brevity_penalty, 12) as brevity_penalty)
from (select avg(case when list_contains(golds, pred) then 1.0 else 0.0 end) as accuracy from ({_cleaned_sql()})) r,
({S.rouge_n_sql(f"select idx as id, pred, golds as refs from ({_cleaned_sql()})")}) g,
({S.bleu_sql(f"select idx as id, pred, golds as refs from ({_cleaned_sql()})", detail=True)}) b"""


def forms_conversion_rate(spark, sf):
    """A cleaned form counts as converted when its parentheses balance and
    it is a parenthesised expression; failures stay in the denominator."""
    c = _cleaned(spark, sf)
    lisp = T.clean_lisp("pred")
    ok = (lisp.startswith("(") & (F.length(lisp) - F.length(F.replace(lisp, F.lit("("), F.lit("")))
                                  == F.length(lisp) - F.length(F.replace(lisp, F.lit(")"), F.lit("")))))
    return c.agg(M.conversion_rate(ok).alias("conversion_rate"))


_L = S.clean_lisp("pred")
SQL_CONVERSION_RATE = f"""select avg(case when starts_with({_L}, '(') and
  length({_L}) - length(replace({_L}, '(', '')) = length({_L}) - length(replace({_L}, ')', '')) then 1.0 else 0.0 end) as conversion_rate
from ({_cleaned_sql()})"""


# --- text-pair metrics (F4) --------------------------------------------------

def _pairs(spark, sf):
    p = text_pairs(Tables(spark, sf))
    return p.select(F.concat_ws(":", "conv_id", "turn").alias("id"), "pred", F.array("gold").alias("refs"))


_PAIRS_ROWS = f"select concat_ws(':', conv_id, turn) as id, coalesce(pred, '') as pred, [gold] as refs from ({TEXT_PAIRS_SQL})"


def bleu_conversations(spark, sf):
    """M4 + M5 + M6: corpus BLEU of assistant turns against the user turns, with
    the components."""
    b = M.bleu(_pairs(spark, sf), "pred", "refs", "id", detail=True)
    return b.withColumn("bleu", F.round("bleu", DIGITS)).withColumn("brevity_penalty", F.round("brevity_penalty", DIGITS))


SQL_BLEU_CONV = f"""select * replace (round(bleu, 12) as bleu, round(brevity_penalty, 12) as brevity_penalty)
from ({S.bleu_sql(_PAIRS_ROWS, detail=True)})"""


def tok13a_conversations(spark, sf):
    """M6: 13a token count of each whole assistant turn and a digest of its
    complete token sequence."""
    p = _pairs(spark, sf)
    t = M.tok13a("pred")
    return p.select("id", F.size(t).cast("bigint").alias("n_tokens"),
                    F.md5(F.array_join(t, " ")).alias("tokens_md5"))


SQL_TOK13A = f"""select id, cast(len(t) as bigint) as n_tokens, md5(array_to_string(t, ' ')) as tokens_md5
from (select id, {S.tok13a('pred')} as t from ({_PAIRS_ROWS}))"""


def rouge_conversations(spark, sf):
    """M7: ROUGE-1 / ROUGE-2 F1 (percent, 4 decimals)."""
    per = M.rouge_n(_pairs(spark, sf), "pred", "refs", "id")
    return M.rouge_summary(per, ["rouge1", "rouge2"])


SQL_ROUGE_CONV = S.rouge_n_sql(_PAIRS_ROWS)


def rouge_l_conversations(spark, sf):
    """M8: ROUGE-L / ROUGE-Lsum F1 (percent, 4 decimals); LCS in Arrow batches."""
    per = M.rouge_l(_pairs(spark, sf), "pred", "refs", keep=["id"])
    return M.rouge_summary(per, ["rougeL", "rougeLsum"])


def rouge_l_rows(spark, sf):
    """M8: ROUGE-L F1 of every answered turn."""
    return M.rouge_l(_pairs(spark, sf), "pred", "refs", keep=["id"]).select("id", F.round("rougeL", DIGITS).alias("rouge_l"))


SQL_ROUGE_L_ROWS = S.rouge_l_sql(_PAIRS_ROWS)
SQL_ROUGE_L_CONV = S.rouge_l_summary_sql(_PAIRS_ROWS)


def _documents(spark, sf):
    """Every document as the prediction of the next one."""
    d = Tables(spark, sf).documents
    refs = d.select((F.col("doc_id") - 1).alias("id"), F.array("text").alias("refs"))
    return d.select(F.col("doc_id").alias("id"), F.col("text").alias("pred")).join(refs, "id")


HUGE = 6000              # characters beyond which these queries' rows are cut into ranges
_DOCUMENT_ROWS = "select a.doc_id as id, a.text as pred, [b.text] as refs from documents a join documents b on b.doc_id = a.doc_id + 1"


def bleu_documents(spark, sf):
    """M4 on long texts: rows of more than ``HUGE`` characters by ranges of tokens and shuffled n-gram counts, the others at once."""
    b = M.bleu(_documents(spark, sf), "pred", "refs", "id", detail=True, huge_chars=HUGE, piece=500)
    return b.withColumn("bleu", F.round("bleu", DIGITS)).withColumn("brevity_penalty", F.round("brevity_penalty", DIGITS))


SQL_BLEU_DOCUMENTS = f"""select * replace (round(bleu, 12) as bleu, round(brevity_penalty, 12) as brevity_penalty)
from ({S.bleu_sql(_DOCUMENT_ROWS, detail=True)})"""


def rouge_documents(spark, sf):
    """M7 on long texts, cut as in ``bleu_documents``."""
    per = M.rouge_n(_documents(spark, sf), "pred", "refs", "id", huge_chars=HUGE, piece=500)
    return M.rouge_summary(per, ["rouge1", "rouge2"])


SQL_ROUGE_DOCUMENTS = S.rouge_n_sql(_DOCUMENT_ROWS)


def token_lengths(spark, sf):
    """M9 + M10 on F7: labels unmasked (-100 -> pad), mean non-pad length per
    user.  Counted as an aggregate, never collected into per-user arrays."""
    tk = token_ids(Tables(spark, sf))
    un = tk.select("user_id", M.unmask_label("token_id", PAD_ID).alias("tok"))
    per_user = un.groupBy("user_id").agg(M.count_non_pad("tok", PAD_ID).alias("gen_len"))
    return per_user.agg(F.avg("gen_len").alias("mean_gen_len"), F.count(F.lit(1)).alias("n_users"))


SQL_TOKEN_LENGTHS = f"""select avg(gen_len) as mean_gen_len, count(*) as n_users from (
  select user_id, count(*) filter (where (case when token_id = -100 then {PAD_ID} else token_id end) <> {PAD_ID}) as gen_len
  from ({TOKENS_SQL}) group by user_id)"""


# --- preparation (F2, F5) ----------------------------------------------------

def prompts_fill(spark, sf):
    """P1 + P3: inference prompts for every question, and the seq2seq prefix form."""
    f = _forms(spark, sf)
    return f.select("idx", P.fill_prompt(TEMPLATE, "question").alias("prompt"),
                    P.with_prefix("question", "turn into SPARQL: ").alias("prefixed"))


_TQ = S.q(TEMPLATE)
SQL_PROMPTS_FILL = f"""select idx, replace(replace({_TQ}, '{{{{input}}}}', question), '{{{{output}}}}', '') as prompt,
  'turn into SPARQL: ' || question as prefixed from ({FORMS_SQL})"""


def prompts_split(spark, sf):
    """Flagship P2 -> P5 -> P6: training texts, deterministic 80/20 split,
    counted per side with their mean length."""
    t = training_pairs_fixture(Tables(spark, sf))
    d = P.training_pairs(t, "output").select("idx", P.fill_training(TEMPLATE, "input", "target").alias("text"))
    d = d.withColumn("side", P.split_side("idx", DEV_SHARE, SPLIT_SEED))
    return d.groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.avg(F.length("text")).alias("mean_len"))


_SPLIT_SQL = (f"case when (('0x' || substr(md5('{SPLIT_SEED}:' || idx), 1, 8))::bigint) / 4294967296.0 < {DEV_SHARE} "
              "then 'dev' else 'train' end")
SQL_PROMPTS_SPLIT = f"""select side, count(*) as n, avg(length(text)) as mean_len from (
  select replace(replace({_TQ}, '{{{{input}}}}', input), '{{{{output}}}}', output) as text, {_SPLIT_SQL} as side
  from ({TRAINING_SQL})) group by side"""


def definition_prompts(spark, sf):
    """One definition prompt per (form, mention) position."""
    f = _forms(spark, sf)
    return P.definition_prompts(f, "idx", "gold", "question", DEF_TEMPLATE) \
            .select("idx", F.col("pos").cast("bigint").alias("pos"), "mention", "prompt")


SQL_DEFINITION_PROMPTS = f"""select idx, cast(generate_subscripts(e, 1) - 1 as bigint) as pos, unnest(e) as mention,
  replace(replace({S.q(DEF_TEMPLATE)}, '<ENTITY>', unnest(e)), '<QUESTION>', question) as prompt
from (select idx, question, {S.entities('gold')} as e from ({FORMS_SQL}))"""


def _echo_model():
    """Deterministic stand-in generator (no model download): answers every
    prompt with its last line, upper-cased."""
    def gen(prompts):
        return [p.strip().split("\n")[-1].upper() for p in prompts]
    return gen


def prompts_infer(spark, sf):
    """Batched generation over every prompt, one model per partition."""
    f = _forms(spark, sf).select("idx", P.fill_prompt(TEMPLATE, "question").alias("prompt"))
    return P.infer(f, "prompt", _echo_model, batch=16)


def sentences_pairs(spark, sf):
    """Sentence-per-line form of the assistant turns (before ROUGE-Lsum)."""
    p = _pairs(spark, sf)
    return p.select("id", P.sentences(F.coalesce("pred", F.lit(""))).alias("lines"))


SQL_SENTENCES = f"select id, regexp_replace(pred, '([.!?])[ \\t]+', '\\1\n', 'g') as lines from ({_PAIRS_ROWS})"


QUERIES = {
    "forms_after_last": (forms_after_last, SQL_AFTER_LAST),
    "forms_after_first": (forms_after_first, SQL_AFTER_FIRST),
    "forms_strip_wrapper": (forms_strip_wrapper, SQL_STRIP_WRAPPER),
    "forms_clean": (forms_clean, SQL_CLEAN),
    "forms_split": (forms_split, SQL_SPLIT),
    "forms_entities": (forms_entities, SQL_ENTITIES),
    "forms_relations": (forms_relations, SQL_RELATIONS),
    "forms_skeleton": (forms_skeleton, SQL_SKELETON),
    "forms_gold_aliases": (forms_gold_aliases, SQL_GOLD_ALIASES),
    "forms_clean_lisp": (forms_clean_lisp, SQL_CLEAN_LISP),
    "forms_mentions_rewrite": (forms_mentions_rewrite, SQL_MENTIONS_REWRITE),
    "forms_match_rates": (forms_match_rates, SQL_MATCH_RATES),
    "forms_clean_score": (forms_clean_score, SQL_CLEAN_SCORE),
    "retrieval_report": (retrieval_report, SQL_RETRIEVAL),
    "forms_conversion_rate": (forms_conversion_rate, SQL_CONVERSION_RATE),
    "bleu_conversations": (bleu_conversations, SQL_BLEU_CONV),
    "tok13a_conversations": (tok13a_conversations, SQL_TOK13A),
    "rouge_conversations": (rouge_conversations, SQL_ROUGE_CONV),
    "rouge_l_conversations": (rouge_l_conversations, SQL_ROUGE_L_CONV),
    "bleu_documents": (bleu_documents, SQL_BLEU_DOCUMENTS),
    "rouge_documents": (rouge_documents, SQL_ROUGE_DOCUMENTS),
    "rouge_l_rows": (rouge_l_rows, SQL_ROUGE_L_ROWS),
    "token_lengths": (token_lengths, SQL_TOKEN_LENGTHS),
    "prompts_fill": (prompts_fill, SQL_PROMPTS_FILL),
    "prompts_split": (prompts_split, SQL_PROMPTS_SPLIT),
    "definition_prompts": (definition_prompts, SQL_DEFINITION_PROMPTS),
    "sentences_pairs": (sentences_pairs, SQL_SENTENCES),
    "prompts_infer": (prompts_infer, None),
}
