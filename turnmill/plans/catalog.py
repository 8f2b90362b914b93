"""The registered queries of the core library over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnmill.functions import text, turns
from turnmill.operators import pairs, report, rewrite, scoring, split, tokens, weights
from turnmill.sources import sinks, tables
from turnmill.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

_TURN = """'[{"role":"VARCHAR","content":"VARCHAR","score":"DOUBLE","attunement_score":"DOUBLE","synthetic":"BOOLEAN"}]'"""
_S = f"with s as (select *, case when json_valid(turns) then from_json(turns, {_TURN}) end as t from sft_chains_scored)"
_P = "with p as (select * replace (" + ", ".join(f"case when json_valid({c}) then from_json({c}, {_TURN}) end as {c}" for c in ("fork", "chosen_branch", "rejected_branch")) + ") from dpo_final)"
_CHARS = "coalesce(list_sum(list_transform({0}, lambda t: coalesce(length(t.content), 0))), 0)"


def query(sql: str | None = None, name: str | None = None):
    def register(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE[name or f.__name__] = sql
        return f

    return register


def _sft(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "sft_chains_scored").withColumn("turns", turns.decode("turns"))


def _dpo(s: SparkSession, d: str) -> DataFrame:
    return pairs.typed(table(s, d, "dpo_final"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(F.col(c).cast("double"), 6).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def _keys(turn):
    return F.array_join(F.array_sort(F.map_keys(turn)), ",")


_ADJ = """unnest(list_filter(list_transform(range(1, len(t)), lambda i: {'u': t[i], 'a': t[i + 1], 'n': i}), lambda x: x.u.role = 'user' and x.a.role = 'assistant')) as x"""


@query(_S + f", a as (select chain_id, {_ADJ} from s where len(t) >= 2) select chain_id, x.n::int as turn_no, x.u.content as user, x.a.content as assistant from a")
def adjacent_pairs(s, d):
    """Replies with the user turn before them."""
    return scoring.exploded_pairs(_sft(s, d), "chain_id", F.col("turns"))


_FLAT = "f as (select chain_id, generate_subscripts(t, 1) - 1 as turn_no, unnest(t).content as c from s)"
_CLEAN = r"regexp_replace(regexp_replace(c, '[^\p{L}\p{N}\x00-\x7F]', ' ', 'g'), '[^\x00-\x7F]', 'q', 'g')"
_LISTED = lambda ws: "len(regexp_extract_all(" + _CLEAN + ", '(?i)\\b(?:" + "|".join(ws).replace("'", "''") + ")\\b'))"
_SENT = r"list_filter(string_split(regexp_replace(regexp_replace(c, '^\s+|\s+$', '', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')"
_COUNTS = f"""len({_SENT}) as n_sentences, len(regexp_extract_all(c, '[a-zA-Z'']+')) as n_words,
 length(array_to_string(regexp_extract_all(c, '[a-zA-Z'']+'), '')) as n_word_chars, {_LISTED(text.CONTRACTIONS)} as n_contractions, {_LISTED(text.PRONOUNS)} as n_pronouns,
 len(list_filter({_SENT}, lambda x: rtrim(x).ends_with('?'))) as n_questions, len(list_filter({_SENT}, lambda x: rtrim(x).ends_with('!'))) as n_exclamations,
 {_LISTED(text.HEDGES)} as n_hedges, {_LISTED(text.INFORMAL)} as n_informal, len(regexp_extract_all(c, '[.,;:!?\\-"''()\\[\\]{{}}]')) as n_punctuation, length(c) as n_chars"""


@query(_S + ", " + _FLAT + f" select chain_id, turn_no::int as turn_no, {_COUNTS} from f where c is not null")
def text_features(s, d):
    """Raw style counts of every turn."""
    t = _sft(s, d).select("chain_id", F.posexplode("turns").alias("turn_no", "t")).filter("t.content is not null")
    return t.select("chain_id", "turn_no", *[c.alias(k) for k, c in text.counts(F.col("t.content")).items()])


def _alignment(s, d):
    return scoring.turn_alignment(_sft(s, d), "chain_id", F.col("turns"))


_VEC = "[greatest(n_words,1)/greatest(n_sentences,1), n_word_chars/greatest(n_words,1), n_contractions/greatest(n_words,1), n_pronouns/greatest(n_words,1), n_questions/greatest(n_sentences,1), n_exclamations/greatest(n_sentences,1), n_hedges/greatest(n_words,1), n_informal/greatest(n_words,1), n_punctuation/greatest(n_chars,1)]"
_ALIGN = f"""{_S}, a as (select chain_id, {_ADJ} from s where len(t) >= 2),
 b as (select chain_id, x.n as turn_no, 'u' as side, coalesce(x.u.content, '') as c from a union all select chain_id, x.n, 'a', coalesce(x.a.content, '') from a),
 n as (select chain_id, turn_no, side, {_COUNTS} from b), v as (select chain_id, turn_no, side, {_VEC} as v from n),
 l as (select chain_id, turn_no, side, generate_subscripts(v, 1) as k, unnest(v) as x from v),
 st as (select k, avg(x) as m, case when stddev_pop(x) < 1e-8 then 1.0 else stddev_pop(x) end as sd from l group by k),
 z as (select chain_id, turn_no, side, k, (x - m) / sd as z from l join st using (k)),
 w as (select u.chain_id, u.turn_no, sum(u.z * a.z) as dot, sqrt(sum(u.z * u.z)) * sqrt(sum(a.z * a.z)) as size from z u join z a using (chain_id, turn_no, k) where u.side = 'u' and a.side = 'a' group by all),
 g as (select chain_id, turn_no, dot / case when size < 1e-8 then 1.0 else size end as alignment from w)"""


@query(_ALIGN + " select chain_id, turn_no::int as turn_no, round(alignment, 6) as alignment from g")
def turn_alignment(s, d):
    """Style alignment of every reply."""
    return _rounded(_alignment(s, d))


@query(_ALIGN + ", c as (select chain_id, avg(alignment) as m from g group by all) select chain_id, round(coalesce(m, 0)::float::double, 5) as attunement_score from s left join c using (chain_id)")
def chain_alignment(s, d):
    return scoring.chain_alignment(_sft(s, d), "chain_id", _alignment(s, d)).select("chain_id", F.round(F.col("attunement_score").cast("double"), 5).alias("attunement_score"))


@query(_ALIGN + """, c as (select coalesce(m, 0)::float::double as v from s left join (select chain_id, avg(alignment) as m from g group by all) using (chain_id))
 select 'attunement_score' as measure, round(avg(v), 5) as mean, round(stddev_pop(v), 5) as std, round(min(v), 5) as least, round(max(v), 5) as most, round(quantile_cont(v, .5), 5) as median,
 round(quantile_cont(v, .1), 5) as p10, round(quantile_cont(v, .25), 5) as p25, round(quantile_cont(v, .75), 5) as p75, round(quantile_cont(v, .9), 5) as p90 from c""")
def chain_alignment_stats(s, d):
    df = report.score_summary(scoring.chain_alignment(_sft(s, d), "chain_id", _alignment(s, d)))
    return df.select(*[F.round(c, 5).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(_ALIGN + """, c as (select chain_id, avg(alignment) as m from g group by all), r as (select chain_id, json_extract(turns, '$[*]') as js from sft_chains_scored where json_valid(turns) and json_type(turns) = 'ARRAY'),
 j as (select chain_id, generate_subscripts(js, 1) - 1 as turn_no, unnest(js) as j from r)
 select j.chain_id, j.turn_no::int as turn_no, array_to_string(list_sort(list_distinct(list_concat(json_keys(j), case when g.alignment is null then [] else ['attunement_score'] end))), ',') as keys,
 coalesce(round_even(g.alignment, 6), round(try_cast(j->>'attunement_score' as double), 6)) as turn_score, round(coalesce(m, 0)::float::double, 5) as attunement_score from j left join g using (chain_id, turn_no) left join c using (chain_id)""")
def embed_turn_scores(s, d):
    """Chains with the alignment written into their turns: per turn its keys, which all survive, and its score."""
    df = table(s, d, "sft_chains_scored").drop("attunement_score")
    out = scoring.embed_alignment(df, "chain_id", _alignment(s, d))
    t = out.select("chain_id", "attunement_score", F.posexplode(turns.decode_whole("turns")).alias("turn_no", "t"))
    score = F.round(F.try_variant_get(F.col("t")["attunement_score"], "$", "double"), 6)
    return t.select("chain_id", "turn_no", _keys(F.col("t")).alias("keys"), score.alias("turn_score"), F.round(F.col("attunement_score").cast("double"), 5).alias("attunement_score"))


def _weight_sql(mode: str, floor: float, t: str = "t") -> str:
    a = f"case when {t}.attunement_score is null then 0.5 when isnan({t}.attunement_score) then {floor} else greatest({floor}, {t}.attunement_score) end"
    g = f"ln(1 + greatest(0, coalesce({t}.score, 0)))"
    w = {"attunement_only": a, "additive": f"({a}) + 0.3 * {g}"}.get(mode, f"({a}) * (1 + 0.3 * {g})")
    return f"case when {t}.role = 'assistant' then {w} else 0 end"


def _register_weights():
    for label, mode in (("gate", "gate_amplify"), ("attonly", "attunement_only"), ("additive", "additive")):
        for version, floor in (("", 0.1), ("v1_", 0.0)):
            sql = f"{_S} select chain_id, list_transform(t, lambda m: round({_weight_sql(mode, floor, 'm')}, 6)) as turn_weights from s where t is not null"

            def run(s, d, mode=mode, floor=floor):
                w = weights.turn_weights(F.col("turns"), 0.3, mode, floor)
                return _sft(s, d).filter("turns is not null").select("chain_id", F.transform(w, lambda x: F.round(x, 6)).alias("turn_weights"))

            query(sql, f"turn_weights_{version}{label}")(run)


_register_weights()
_KEPT = f"{_S}, k as (select chain_id, list_transform(t, lambda m: {_weight_sql('gate_amplify', 0.1, 'm')}) as w from s where chain_depth >= 3 and total_score >= 0 and t is not null), m as (select avg(x) as mean, stddev_pop(x) as sd from (select unnest(w) as x from k) where x > 0)"


def _norm(s, d, most):
    out = weights.normalise_turn_weights(pairs.sft_rows(table(s, d, "sft_chains_scored")), most=most)
    return out.select("chain_id", F.transform("turn_weights", lambda x: F.round(x, 6)).alias("turn_weights"))


@query(_KEPT + " select chain_id, list_transform(w, lambda x: round(case when x > 0 then case when sd <= 1e-8 then 1 else least(x / mean, 3) end else 0 end, 6)) as turn_weights from k, m")
def sft_norm_v2(s, d):
    return _norm(s, d, 3.0)


@query(_KEPT + " select chain_id, list_transform(w, lambda x: round(case when x > 0 then case when sd <= 1e-8 then 1 else x / mean end else 0 end, 6)) as turn_weights from k, m")
def sft_norm_v1(s, d):
    return _norm(s, d, None)


@query(_KEPT + ", c as (select case when sd <= 1e-8 then 1 else least(x / mean, 3) end as x from (select unnest(w) as x from k), m where x > 0) select count(*) as n, round(avg(x), 6) as mean, round(stddev_pop(x), 6) as std, round(min(x), 6) as least, round(max(x), 6) as largest from c")
def weight_stats(s, d):
    """Positive turn weights after normalising and clamping."""
    return _rounded(weights.weight_statistics(weights.normalise_turn_weights(pairs.sft_rows(table(s, d, "sft_chains_scored")))))


@query("select chain_id, chain_depth, total_score from sft_chains_scored where chain_depth >= 3 and total_score >= 0 and json_valid(turns)")
def sft_filter(s, d):
    return pairs.sft_rows(table(s, d, "sft_chains_scored")).select("chain_id", "chain_depth", "total_score")


@query("""select chain_id, row_number() over (order by md5('42:' || chain_id)) <= ceil(count(*) over () * 0.05) as is_test from sft_chains_scored""")
def sft_split(s, d):
    return split.train_test(table(s, d, "sft_chains_scored").select("chain_id"), "chain_id")


@query("select pair_id, subreddit from dpo_final order by md5('42:' || pair_id) limit 100")
def sample_k(s, d):
    return split.sample(table(s, d, "dpo_final").select("pair_id", "subreddit"), "pair_id", 100)


_EX = f"coalesce(list_avg(list_filter(list_transform(chosen_branch, lambda t: {_weight_sql('gate_amplify', 0.1)}), lambda x: x > 0)), 1.0)"


@query(f"{_P} select pair_id, round({_EX}, 6) as weight from p")
def example_weight(s, d):
    return _dpo(s, d).select("pair_id", F.round(weights.example_weight(F.col("chosen_branch")), 6).alias("weight"))


_DPO = "score_delta >= 0 and coalesce(length_matched, false)"


def _dpo_norm(s, d, most):
    out = weights.normalise_weight(pairs.dpo_rows(table(s, d, "dpo_final"), chosen_weighting=True), most=most)
    return out.select("pair_id", F.round("chosen_weight", 6).alias("chosen_weight"))


for _name, _most in (("dpo_norm_v2", 2.0), ("dpo_norm_v1", None)):
    _x = "w / m" if _most is None else f"least(w / m, {_most})"
    query(f"{_P}, k as (select pair_id, {_EX} as w from p where {_DPO}), st as (select avg(w) as m, stddev_pop(w) as sd from k) select pair_id, round(case when sd <= 1e-8 then 1 else {_x} end, 6) as chosen_weight from k, st", _name)(lambda s, d, most=_most: _dpo_norm(s, d, most))


# isnan would be folded away here, as the file's statistics leave NaN out
@query(f"select pair_id, case when score_delta::varchar = 'nan' then null else score_delta end as score_delta from dpo_final where {_DPO}")
def dpo_filter(s, d):
    """Pairs for training; NaN, which is above every bound, is shown as null."""
    return pairs.dpo_rows(table(s, d, "dpo_final")).select("pair_id", F.nanvl("score_delta", F.lit(None).cast("double")).alias("score_delta"))


_SAID = "list_transform({0}, lambda t: coalesce(t.role, '') || '|' || coalesce(t.content, '')) as {1}"


@query(f"{_P} select pair_id, {_SAID.format('fork', 'prompt')}, {_SAID.format('chosen_branch', 'chosen')}, {_SAID.format('rejected_branch', 'rejected')}, round({_EX}, 6) as chosen_weight from p where {_DPO}")
def dpo_training_rows(s, d):
    """Prompt, chosen and rejected messages with the weight of the chosen ones."""
    out = pairs.dpo_rows(table(s, d, "dpo_final"), chosen_weighting=True)
    said = lambda c: F.transform(c, lambda t: F.concat_ws("|", F.coalesce(t["role"], F.lit("")), F.coalesce(t["content"], F.lit(""))))
    return out.select("pair_id", *[said(c).alias(c) for c in ("prompt", "chosen", "rejected")], F.round("chosen_weight", 6).alias("chosen_weight"))


@query(f"{_P} select pair_id, round({_EX.replace(_weight_sql('gate_amplify', 0.1), _weight_sql('gate_amplify', 0.0))}, 6) as weight from p")
def example_weight_v1(s, d):
    return _dpo(s, d).select("pair_id", F.round(weights.example_weight(F.col("chosen_branch"), floor=0.0), 6).alias("weight"))


@query(_S + ", " + _FLAT.replace("unnest(t).content as c", "unnest(t) as m") + " select chain_id, turn_no::int as turn_no, m.role as role, m.content as content from f")
def strip_messages(s, d):
    return _sft(s, d).select("chain_id", F.posexplode(turns.strip(F.col("turns"))).alias("turn_no", "m")).select("chain_id", "turn_no", "m.role", "m.content")


_SW = "coalesce(fork[-1].role = 'assistant', false)"
_ROLES = "list_transform({0}, lambda t: case when not " + _SW + " then t.role when t.role = 'user' then 'assistant' when t.role = 'assistant' then 'user' else t.role end) as {0}"


_WORDS = "list_transform({0}, lambda t: coalesce(t.content, '')) as {0}_contents"


@query(f"{_P} select pair_id, {_SW} as swapped, {', '.join(f.format(c) for c in ('fork', 'chosen_branch', 'rejected_branch') for f in (_ROLES, _WORDS))} from p")
def role_swap(s, d):
    out = pairs.swap_where_needed(_dpo(s, d))
    own = [x for c in ("fork", "chosen_branch", "rejected_branch") for x in (F.transform(c, lambda t: t["role"]).alias(c), F.transform(c, lambda t: F.coalesce(t["content"], F.lit(""))).alias(f"{c}_contents"))]
    return out.select("pair_id", "swapped", *own)


@query("""with r as (select pair_id, json_extract(rejected_branch, '$[*]') as js, json_extract_string(fork, '$[#-1].role') = 'assistant' as sw from dpo_final where json_valid(rejected_branch) and json_type(rejected_branch) = 'ARRAY'),
 j as (select pair_id, coalesce(sw, false) as sw, generate_subscripts(js, 1) - 1 as turn_no, unnest(js) as j from r)
 select pair_id, turn_no::int as turn_no, array_to_string(list_sort(json_keys(j)), ',') as keys, case when not sw then j->>'role' when j->>'role' = 'user' then 'assistant' when j->>'role' = 'assistant' then 'user' else j->>'role' end as role, length(j->>'content') as chars from j""")
def role_swap_exact(s, d):
    """The swap on the JSON itself, byte for byte but for the roles: every key of every rejected turn survives."""
    df = table(s, d, "dpo_final").withColumn("swap", turns.ends_on_assistant(turns.decode("fork")))
    out = df.select("pair_id", sinks.swap_roles_exact("rejected_branch", F.col("swap")).alias("j"))
    t = out.select("pair_id", F.posexplode(turns.decode_whole("j")).alias("turn_no", "t"))
    return t.select("pair_id", "turn_no", _keys(F.col("t")).alias("keys"), turns.text_of(F.col("t"), "role").alias("role"), F.length(turns.text_of(F.col("t"), "content")).alias("chars"))


@query(f"{_P} select count(*) as pairs, count(*) filter ({_SW}) as swapped, count(*) filter (not {_SW}) as already_ok from p")
def role_swap_stats(s, d):
    return pairs.swap_statistics(pairs.swap_where_needed(_dpo(s, d)))


@query(_S + " select chain_id, case when len(t) < 2 then true else coalesce(not list_bool_or(list_transform(range(1, len(t)), lambda i: coalesce(t[i].role = t[i + 1].role, false))), true) end as alternates from s where t is not null")
def role_alternation(s, d):
    return _sft(s, d).filter("turns is not null").select("chain_id", turns.alternates(F.col("turns")).alias("alternates"))


_LEN = f"{_P}, x as (select *, {_CHARS.format('chosen_branch')} as c, {_CHARS.format('rejected_branch')} as r from p)"


@query(f"{_LEN} select pair_id, round(abs(c - r) / greatest(c, r, 1), 6) as ratio, round((c - r) / greatest(c, r, 1), 6) as signed from x")
def length_ratio(s, d):
    c, r = turns.chars(F.col("chosen_branch")), turns.chars(F.col("rejected_branch"))
    return _dpo(s, d).select("pair_id", F.round(turns.length_ratio(c, r), 6).alias("ratio"), F.round(turns.signed_ratio(c, r), 6).alias("signed"))


_LOW = "coalesce(list_bool_and(list_transform(list_filter(rejected_branch, lambda t: t.role = 'assistant'), lambda t: coalesce(t.score, 0) < 5)), true)"


@query(f"{_LEN} select pair_id from x where abs(c - r) / greatest(c, r, 1) <= 0.3 and {_LOW}")
def skip_matched(s, d):
    df = _dpo(s, d)
    return df.filter(rewrite.needs_no_rewrite(turns.chars(F.col("chosen_branch")), turns.chars(F.col("rejected_branch")), F.col("rejected_branch"))).select("pair_id")


@query(f"""{_P}, e as (select pair_id, generate_subscripts(rejected_branch, 1) - 1 as turn_no, unnest(rejected_branch) as t from p)
 select pair_id, turn_no::int as turn_no, coalesce(length(t.content), 0)::int as target, greatest(1, trunc(coalesce(length(t.content), 0)::double * 0.7::double / 4)::int) as min_tokens,
 greatest(32, trunc(coalesce(length(t.content), 0)::double * 1.3::double / 3)::int) as max_new_tokens from e where t.role = 'assistant' and coalesce(t.score, 0) >= 5""")
def asst_requests(s, d):
    return rewrite.assistant_requests(_dpo(s, d), "pair_id").select("pair_id", "turn_no", "target", "min_tokens", "max_new_tokens")


@query(f"""{_LEN}, y as (select *, len(list_filter(rejected_branch, lambda t: t.role = 'user' or coalesce(t.synthetic, false))) as k from x where abs(c - r) / greatest(c, r, 1) > 0.3),
 e as (select pair_id, c, r, k, generate_subscripts(rejected_branch, 1) - 1 as turn_no, unnest(rejected_branch) as t from y where k > 0)
 select pair_id, turn_no::int as turn_no, t.role as role, greatest(20, coalesce(length(t.content), 0) + floor((c - r) / k))::bigint as target from e where t.role = 'user' or coalesce(t.synthetic, false)""")
def length_match_requests(s, d):
    return rewrite.length_requests(_dpo(s, d), "pair_id").select("pair_id", "turn_no", "role", "target")


@query("""with c as (select doc_id, text, 200 as n, 100 as h from documents where text is not null), m as (select *, regexp_extract(substring(text, h + 2, n - h), '(?s)^(.*[.!?\\n])', 1) as tail from c)
 select doc_id, case when length(text) <= n then text when tail = '' then substring(text, 1, n) else substring(text, 1, h + 1) || tail end as cut from m""")
def truncate_boundary(s, d):
    return table(s, d, "documents").filter("text is not null").select("doc_id", text.truncate_at_boundary(F.col("text"), F.lit(200)).alias("cut"))


_M = "greatest(1, trunc({0}::double * 0.7::double / 4)::int)"
#: What the stand-in generator writes for a target, stripped and cut where overlong.
_ECHO = f"case when {{0}} > 0 and 5 * {_M} - 1 > trunc({{0}}::double * 1.3::double)::int then substring(rtrim(repeat('word ', {_M}::int)), 1, ({{0}})::int) else rtrim(repeat('word ', {_M}::int)) end"
_SIZE = "coalesce(length(t.content), 0)"
_HIGH = "coalesce(t.role = 'assistant', false) and coalesce(t.score, 0) >= 5"
_REWRITTEN = f"""{_LEN}, f as (select *, abs(c - r) / greatest(c, r, 1) <= 0.3 and {_LOW} as skipped from x),
 o as (select *, case when skipped then list_transform(rejected_branch, lambda t: {{'role': t.role, 'content': t.content, 'syn': coalesce(t.synthetic, false), 'new': false}})
  else list_transform(rejected_branch, lambda t: {{'role': t.role, 'content': case when {_HIGH} then {_ECHO.format(_SIZE)} else t.content end, 'syn': {_HIGH} or coalesce(t.synthetic, false), 'new': {_HIGH}}}) end as b from f),
 u as (select *, {_CHARS.format('b')} as br, len(list_filter(b, lambda t: t.role = 'user' or t.syn)) as k from o),
 w as (select *, case when not skipped and k > 0 and abs(c - br) / greatest(c, br, 1) > 0.3 then floor((c - br) / k) end as each from u),
 y as (select *, case when each is null then b else list_transform(b, lambda t: case when coalesce(t.role = 'user', false) or t.syn then {{'role': t.role, 'content': {_ECHO.format(f'greatest(20, {_SIZE} + each)::bigint')}, 'syn': true, 'new': true}} else t end) end as z from w),
 q as (select *, {_CHARS.format('z')} as zr, coalesce(len(list_filter(b, lambda t: t.new)), 0) as asst, case when each is null then 0 else k end as usr from y),
 n as (select *, skipped or abs(c - zr) / greatest(c, zr, 1) <= 0.3 as matched from q)"""


def _rewritten(s, d):
    return rewrite.rewrite_all(table(s, d, "dpo_final"), "pair_id", rewrite.echo_generator)


@query(_REWRITTEN + """, js as (select pair_id, case when json_valid(rejected_branch) then json_extract(rejected_branch, '$[*]') end as j from dpo_final)
 select n.pair_id, asst::bigint as asst_replacements, usr::bigint as user_replacements, matched as length_matched, coalesce(len(z), 0) as rejected_depth, c as chosen_chars, zr as rejected_chars,
 list_transform(z, lambda t: coalesce(t.content, '')) as contents,
 list_transform(j, lambda x, i: array_to_string(list_sort(list_distinct(list_concat(json_keys(x), case when z[i].new then ['content', 'synthetic'] else [] end))), ',')) as keys from n join js using (pair_id) where matched""")
def apply_rewrites(s, d):
    """Pairs after rewriting with the stand-in generator, all phases, assembled: contents and keys of all rejected turns."""
    out = pairs.assemble(_rewritten(s, d).filter("length_matched"), "pair_id")
    said = F.transform(turns.decode("rejected_branch"), lambda t: F.coalesce(t["content"], F.lit("")))
    return out.select("pair_id", "asst_replacements", "user_replacements", "length_matched", "rejected_depth", "chosen_chars", "rejected_chars", said.alias("contents"), F.transform(turns.decode_whole("rejected_branch"), _keys).alias("keys"))


@query(_REWRITTEN + " select count(*) as input, count(*) filter (matched) as kept, count(*) filter (matched and skipped) as skipped, count(*) filter (matched and not skipped) as generated, count(*) filter (not matched) as dropped, coalesce(sum(asst) filter (matched), 0)::bigint as asst_replaced, coalesce(sum(usr) filter (matched), 0)::bigint as user_replaced, count(*) filter (matched) as matched from n")
def rewrite_summary(s, d):
    return rewrite.run_summary(_rewritten(s, d))


@query(f"{_LEN} select pair_id, len(rejected_branch) is null as unread, coalesce(len(rejected_branch), 0) as rejected_depth, c as chosen_chars, r as rejected_chars from x")
def assemble_pairs(s, d):
    a = pairs.assemble(table(s, d, "dpo_final"), "pair_id")
    return a.select("pair_id", F.col("rejected_branch").isNull().alias("unread"), "rejected_depth", "chosen_chars", "rejected_chars")


_META = "source subreddit post_id post_url post_score fork_depth chosen_depth chosen_score rejected_score score_delta".split()
_NO_NAN = {"chosen_score", "rejected_score", "score_delta"}


@query("select pair_id, " + ", ".join(f"case when isnan({c}) then null else {c} end as {c}" if c in _NO_NAN else c for c in _META) + " from dpo_final")
def carried_columns(s, d):
    """The ten columns that an assembled pair carries through."""
    a = pairs.assemble(table(s, d, "dpo_final"), "pair_id")
    return a.select("pair_id", *[F.nanvl(c, F.lit(None).cast("double")).alias(c) if c in _NO_NAN else F.col(c) for c in _META])


_TOUCHED = "coalesce(asst_replacements, 0) + coalesce(user_replacements, 0) > 0"


@query(f"select pair_id, 'synthetic' as kind from dpo_final where source = 'reddit' and {_TOUCHED} union all select pair_id, 'untouched' from dpo_final where source = 'reddit' and not ({_TOUCHED}) union all select pair_id, 'post' from dpo_final where post_id = (select min(post_id) from dpo_final) union all select pair_id, 'community' from dpo_final where subreddit = (select max(subreddit) from dpo_final)")
def selected_pairs(s, d):
    """Pairs by source and rewriting, by post and by community."""
    df = table(s, d, "dpo_final")
    least = df.agg(F.min("post_id").alias("p"), F.max("subreddit").alias("c")).first()
    own = {"synthetic": {"source": "reddit", "synthetic_only": True}, "untouched": {"source": "reddit", "untouched_only": True}, "post": {"post_id": least["p"]}, "community": {"subreddit": least["c"]}}
    return reduce(DataFrame.unionByName, [pairs.select_pairs(df, **how).select("pair_id", F.lit(k).alias("kind")) for k, how in own.items()])


@query("select pair_id from dpo_final where source = 'reddit' order by pair_id limit 50")
def first_selected(s, d):
    """The row limit comes after the filters."""
    return pairs.select_pairs(table(s, d, "dpo_final"), source="reddit", limit=50, order="pair_id").select("pair_id")


@query("with x as (select chain_id, row_number() over (order by md5('42:' || chain_id)) <= ceil(count(*) over () * 0.05) as t from sft_chains_scored) select min(chain_id) as chain_id, t as is_test from x group by t")
def first_of_splits(s, d):
    """The first row of either side of the split."""
    x = split.train_test(table(s, d, "sft_chains_scored").select("chain_id"), "chain_id")
    return split.first(x, "chain_id", False).unionByName(split.first(x, "chain_id", True))


_LEGACY = "with p as (select legacy_id as chain_id, list_concat(case when json_valid(prompt) then from_json(prompt, {0}) end, case when json_valid(chosen) then from_json(chosen, {0}) end) as t from legacy_pairs)".format(_TURN)


@query(_LEGACY + f", a as (select chain_id, {_ADJ} from p where len(t) >= 2) select chain_id as legacy_id, x.n::int as turn_no, x.u.content as user, x.a.content as assistant from a")
def boundary_pairs(s, d):
    """Replies with the turn before them in older rows, where a pair may straddle prompt and answer."""
    df = table(s, d, "legacy_pairs")
    return scoring.exploded_pairs(df, "legacy_id", scoring.boundary_pairs(F.col("prompt"), F.col("chosen")))


@query(f"{_P} select pair_id, coalesce(chosen_branch[-1].role, '?') as chosen_last, coalesce(rejected_branch[-1].role, '?') as rejected_last, list_filter(list_transform(rejected_branch, lambda t, i: case when t.synthetic then i - 1 end), lambda i: i is not null)::int[] as synthetic, len(fork) + len(chosen_branch) as whole from p")
def branch_ends(s, d):
    """Last roles, numbers of the synthetic turns, and turns of fork and chosen branch together."""
    df = _dpo(s, d)
    return df.select("pair_id", turns.last_role(F.col("chosen_branch")).alias("chosen_last"), turns.last_role(F.col("rejected_branch")).alias("rejected_last"), turns.synthetic_slots(F.col("rejected_branch")).alias("synthetic"), F.size(F.concat("fork", "chosen_branch")).alias("whole"))


@query("select doc_id, case when length(text) > 120 then substring(text, 1, 120) || '...' else text end as shown from documents where text is not null")
def shown_texts(s, d):
    return table(s, d, "documents").filter("text is not null").select("doc_id", text.shown(F.col("text")).alias("shown"))


@query("select 'sft_chains_scored.parquet' as shard, count(*) as rows, count(*) filter (chain_depth >= 3 and total_score >= 0) as kept from sft_chains_scored")
def shard_counts(s, d):
    """Rows of each input file and those that the loader keeps."""
    df = table(s, d, "sft_chains_scored")
    return tables.shard_counts(df, F.coalesce((F.col("chain_depth") >= 3) & (F.col("total_score") >= 0), F.lit(False)))


@query("select source, count(*) as rows, round(count(*) * 100 / (select count(*) from dpo_final), 6) as percent from dpo_final group by source")
def source_counts(s, d):
    return _rounded(report.counts_by(table(s, d, "dpo_final"), F.col("source"), "source"))


@query("select coalesce(nullif(subreddit, ''), '(none)') as subreddit, count(*) as rows, round(count(*) * 100 / (select count(*) from dpo_final), 6) as percent from dpo_final group by 1 order by 2 desc, 1 limit 20")
def subreddit_top20(s, d):
    return _rounded(report.top_subreddits(table(s, d, "dpo_final")))


@query("with n as (select post_id, count(*) as n from dpo_final group by 1) select count(*) as posts, round(avg(n), 6) as mean, quantile_cont(n, .5) as median, max(n) as most, round(quantile_cont(n, .9), 6) as p90 from n")
def pairs_per_post(s, d):
    return _rounded(report.pairs_per_post(table(s, d, "dpo_final")))


def _stats_sql(head: str, source: str, cols: dict[str, str], *names: str) -> str:
    how = {"mean": "avg(v)", "std": "stddev_pop(v)", "least": "min(v)", "most": "max(v)", "median": "quantile_cont(v, .5)", **{f"p{p}": f"quantile_cont(v, {p / 100})" for p in (10, 25, 75, 90)}}
    parts = " union all ".join(f"select '{k}' as measure, ({c})::double as v from {source}" for k, c in cols.items())
    return f"{head}, l as ({parts}) select measure, {', '.join(f'round({how[n]}, 6) as {n}' for n in names)} from l where v is not null and not isnan(v) group by measure"


@query(_stats_sql(_P, "p", {"fork": "fork_depth", "chosen": "chosen_depth", "rejected": "len(rejected_branch)"}, "mean", "median", "least", "most"))
def depth_stats(s, d):
    return _rounded(report.depth_statistics(_dpo(s, d)))


@query("with n as (select fork_depth, count(*) as rows from dpo_final group by 1) select * from n where rows >= 0.01 * (select count(*) from dpo_final) or fork_depth <= 10")
def depth_distribution(s, d):
    return report.depth_distribution(table(s, d, "dpo_final"))


@query(_stats_sql(_P, "p", {c: c for c in ("chosen_score", "rejected_score", "score_delta")}, "mean", "median", "p10", "p90"))
def score_stats(s, d):
    return _rounded(report.score_statistics(table(s, d, "dpo_final")))


@query(_stats_sql(_LEN, "x", {"chosen": "c", "rejected": "r"}, "mean", "median", "p90", "most"))
def char_stats(s, d):
    return _rounded(report.char_statistics(_dpo(s, d)))


_BAL = "select count(*) as pairs, round(avg(q), 6) as mean, round(quantile_cont(q, .5), 6) as median, round(quantile_cont(q, .9), 6) as p90, " + ", ".join(f"count(*) filter (q <= {t}) as within_{int(t * 100)}" for t in (0.1, 0.2, 0.3, 0.5)) + ", count(*) filter (c > r) as chosen_longer, count(*) filter (r > c) as rejected_longer from (select c, r, abs(c - r) / greatest(c, r, 1) as q from x {0})"


@query(_LEN + " " + _BAL.format(""))
def length_balance(s, d):
    return _rounded(report.length_balance(_dpo(s, d)))


@query(_LEN + " " + _BAL.format("where coalesce(length_matched, false)"))
def length_balance_matched(s, d):
    return _rounded(report.length_balance(_dpo(s, d), True))


@query("""select count(*) filter (a = 0 and u = 0) as untouched, count(*) filter (a > 0 or u > 0) as touched, count(*) filter (a > 0 and u = 0) as asst_only, count(*) filter (u > 0 and a = 0) as user_only,
 count(*) filter (a > 0 and u > 0) as both from (select coalesce(asst_replacements, 0) as a, coalesce(user_replacements, 0) as u from dpo_final)""")
def synthesis_stats(s, d):
    return report.synthesis_statistics(table(s, d, "dpo_final"))


_REPL = "select 'assistant' as role, asst_replacements as replacements from dpo_final where asst_replacements > 0 union all select 'user', user_replacements from dpo_final where user_replacements > 0"


@query(f"select role, replacements, count(*) as rows from ({_REPL}) group by all")
def replacement_distribution(s, d):
    return report.replacement_distribution(table(s, d, "dpo_final"))


@query(f"select role, count(*) as pairs, round(avg(replacements), 6) as mean, quantile_cont(replacements, .5) as median, max(replacements) as most from ({_REPL}) group by role")
def replacement_stats(s, d):
    return _rounded(report.replacement_statistics(table(s, d, "dpo_final")))


@query("select count(distinct coalesce(nullif(subreddit, ''), '(none)')) as communities from dpo_final")
def community_count(s, d):
    return report.community_count(table(s, d, "dpo_final"))


@query(f"{_P} select count(*) filter (t.role = 'assistant') as assistant, count(*) filter (coalesce(t.role, '') <> 'assistant') as user from (select unnest(rejected_branch) as t from p) where t.synthetic")
def synthetic_flags(s, d):
    return report.synthetic_flags(_dpo(s, d))


@query(f"{_P}, y as (select floor(coalesce(sum({_CHARS.format('fork')} + {_CHARS.format('chosen_branch')} + {_CHARS.format('rejected_branch')}), 0) / 4)::bigint as tokens, count(*) as n from p) select tokens, floor(tokens / greatest(n, 1))::bigint as tokens_per_pair from y")
def token_estimate(s, d):
    return report.token_estimate(_dpo(s, d))


@query("""with v as (select chosen_chars as v from dpo_final where chosen_chars is not null), e as (select min(v) as lo, max(v) as hi, greatest(floor((max(v) - min(v)) / 10), 1)::bigint as step from v)
 select bin, any_value(lo + bin * step)::bigint as start, count(*) as rows from (select least(floor((v - lo) / step), 9)::bigint as bin, lo, step from v, e where hi > lo) group by bin""")
def histogram10(s, d):
    return report.histogram(table(s, d, "dpo_final"), F.col("chosen_chars"))


_ENC = "flatten(list_transform({0}, lambda t: list_concat(['<' || coalesce(t.role, '') || '>'], list_filter(string_split_regex(coalesce(t.content, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> ''), ['</s>'])))"
_CHECKS = f"""{_P}, e as (select pair_id, unnest(['chosen', 'rejected']) as branch, coalesce(fork, []) as f, unnest([coalesce(chosen_branch, []), coalesce(rejected_branch, [])]) as b from p),
 w as (select *, list_concat(f, b) as whole from e), i as (select *, list_concat({_ENC.format('f')}, ['<assistant>']) as fi, {_ENC.format('whole')} as wi from w), c as (select *, wi[1:512] as cut from i),
 k as (select pair_id, branch, len(wi) > 512 as truncated, case when len(cut) >= len(fi) and cut[1:len(fi)] = fi then 'OK' else 'FAIL' end as prefix, case when len(cut) > len(fi) then 'OK' else 'FAIL' end as response,
 case when coalesce(cut[-1] = '</s>', false) then 'OK' else 'WARN' end as ending, case when b[-1].role in ('assistant', 'user') then 'OK' else 'WARN' end as last_role,
 case when len(whole) >= 2 and coalesce(list_bool_or(list_transform(range(1, len(whole)), lambda i: coalesce(whole[i].role = whole[i + 1].role, false))), false) then 'WARN' else 'OK' end as alternation from c)"""


@query(_CHECKS + """, l as (select branch, unnest(['prefix', 'shared', 'response', 'end', 'last_role', 'stable', 'alternation']) as "check", unnest([prefix, 'OK', response, ending, last_role, 'OK', alternation]) as status, truncated from k)
 select branch, "check", status, count(*) as pairs, count(*) filter (truncated) as truncated from l group by all""")
def branch_checks(s, d):
    """Checks of both branches of each pair with the stand-in tokenizer: pairs per check and outcome, and those cut to the length."""
    return tokens.branch_checks(_dpo(s, d), "pair_id").groupBy("branch", "check", "status").agg(F.count(F.lit(1)).alias("pairs"), F.count_if("truncated").alias("truncated"))


@query(_CHECKS + " select pair_id, branch, prefix as status from k")
def prefix_check(s, d):
    """Whether the fork with the generation prompt is a prefix of fork and branch: not so where the branch starts on another role."""
    return tokens.branch_checks(_dpo(s, d), "pair_id").filter(F.col("check") == "prefix").select("pair_id", "branch", "status")


def _labels(s, d):
    """Labels derived from the chains: a run of code points per turn, masked unless the assistant speaks."""
    ids = F.flatten(F.transform("turns", lambda t: F.transform(F.filter(F.split(F.coalesce(t["content"], F.lit("")), " "), lambda w: w != ""), lambda w: F.when(t["role"] == "assistant", F.length(w)).otherwise(F.lit(-100)))))
    df = _sft(s, d).filter("turns is not null")
    return tokens.token_weights(df.select("chain_id", ids.alias("labels"), weights.turn_weights(F.col("turns")).alias("w")), "chain_id", "labels", "w")


_TOK = f"""{_S}, w as (select chain_id, list_filter(list_transform(t, lambda m: {_weight_sql('gate_amplify', 0.1, 'm')}), lambda x: x > 0) as w, generate_subscripts(t, 1) as n, unnest(t) as m from s),
 i as (select chain_id, w, n, m.role as role, list_filter(string_split(coalesce(m.content, ''), ' '), lambda x: x <> '') as ws from w), f as (select chain_id, w, n, generate_subscripts(ws, 1) as k, case when role = 'assistant' then length(unnest(ws)) else -100 end as label from i),
 p as (select chain_id, w, label, row_number() over (partition by chain_id order by n, k) - 1 as pos from f), r as (select *, case when label <> -100 and coalesce(lag(label) over (partition by chain_id order by pos), -100) = -100 then 1 else 0 end as st from p),
 q as (select *, sum(st) over (partition by chain_id order by pos) as run from r), tw as (select chain_id, pos, label, case when label = -100 then 0 else coalesce(w[run::int], 1) end as weight from q)"""


@query(_TOK + " select chain_id, count(*) as tokens, round(sum(weight), 4) as weight, count(*) filter (weight > 0) as weighted from tw group by chain_id")
def token_weights(s, d):
    return _labels(s, d).groupBy("chain_id").agg(F.count(F.lit(1)).alias("tokens"), F.round(F.sum("weight"), 4).alias("weight"), F.count_if(F.col("weight") > 0).alias("weighted"))


@query(_TOK + " select chain_id, round(sum((pos % 7 + 1) * weight) / greatest(sum(weight), 1), 6) as loss from tw group by chain_id")
def weighted_loss(s, d):
    return _rounded(tokens.weighted_loss(_labels(s, d).withColumn("l", (F.col("pos") % 7 + 1).cast("double")), "chain_id", "l", "weight"))


@query(_TOK + ", sh as (select chain_id, label, coalesce(lead(label) over (partition by chain_id order by pos), -100) as target from tw) select chain_id, round(coalesce(count(*) filter (target <> -100 and label = target) / nullif(count(*) filter (target <> -100), 0), 0), 6) as accuracy from sh group by chain_id")
def masked_accuracy(s, d):
    return _rounded(tokens.masked_accuracy(tokens.shifted(_labels(s, d), "chain_id"), "label", "target", "chain_id"))


@query(f"{_P}, b as (select pair_id % 97 as batch, {_EX} as w, (pair_id % 11)::double as l from p) select batch, round(avg(l) * avg(w), 6) as loss from b group by batch")
def dpo_batch_loss(s, d):
    x = _dpo(s, d).select((F.col("pair_id") % 97).alias("batch"), weights.example_weight(F.col("chosen_branch")).alias("w"), (F.col("pair_id") % 11).cast("double").alias("l"))
    return _rounded(tokens.batch_loss(x, "batch", "l", "w"))
