"""The registered queries of this package: ``pN_...`` of problem N, and the SQL of those that have any."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnmill.functions.keys import community_key, language_key, post_key, source_key
from turnmill.llm import abuse, budget, capping, defects, garbled, grouping, leakage, overlap, personal, tokenizer
from turnmill.session import checkpointed
from turnmill.sources.tables import table

TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
PROPORTIONS = {"train": 0.9, "validation": 0.05, "test": 0.05}


def _contributor():
    return F.coalesce(F.concat(F.lit("c:"), community_key("subreddit")), F.concat(F.lit("s:"), source_key("source")), F.lit("none"))


def p1_marked(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "dpo_final").select("pair_id", "source", "subreddit", "score_delta", _contributor().alias("contributor"))
    return capping.mark_capped(pairs, F.col("contributor"), F.col("score_delta"), F.col("pair_id"), max_share=1 / 50)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs that the cap of a fiftieth of all rows removes."""
    return p1_marked(spark, d).filter(~F.col("kept")).select("pair_id").distinct()


def p1_contributors(spark: SparkSession, d: str) -> DataFrame:
    """Rows kept and removed per contributor."""
    m = p1_marked(spark, d)
    return m.groupBy("contributor").agg(F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("removed"))


def _keys(spark: SparkSession, d: str) -> DataFrame:
    own = [(t, i) for t, i in (("sft_chains_scored", "chain_id"), ("dpo_final", "pair_id"))]
    a, b = (table(spark, d, t).select(F.lit(t).alias("tbl"), F.col(i).alias("rec_id"), community_key("subreddit").alias("community"), post_key("post_id").alias("post")) for t, i in own)
    return a.unionByName(b)


def _conversations(spark: SparkSession, d: str) -> DataFrame:
    split = F.lower(F.trim("split"))
    own = [("sft_chains_scored", "chain_id", "turns"), ("dpo_final", "pair_id", "fork")]
    a, b = (
        table(spark, d, t).select(F.lit(t).alias("tbl"), F.col(i).alias("id"), split.alias("split"), source_key("source").alias("source"), F.col(c).alias("conversation"))
        for t, i, c in own
    )
    both = a.unionByName(b).filter(F.col("split").isin("train", "validation", "test"))
    return overlap.prepare(both.withColumn("is_train", F.col("split") == "train"), F.col("conversation"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of rows of one table, one in training and one in evaluation, with the same conversation."""
    prepared = _conversations(spark, d)
    return overlap.cross_split_pairs(prepared, checkpointed(overlap.same_classes(prepared)))


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    """Per table, evaluation split and source: rows, and rows whose conversation is in training."""
    prepared = _conversations(spark, d)
    return overlap.overlap_report(prepared, overlap.same_classes(prepared))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of communities that posts link, directly or through others."""
    c = grouping.group_components(_keys(spark, d).select("community", "post")).filter(F.col("node").startswith("c:"))
    c = c.select(F.substring("node", 3, 1 << 30).alias("name"), "component")
    # the pairs of a component are made in parts, as one component may hold most communities
    a = c.select(F.col("name").alias("subreddit_a"), "component", F.pmod(F.xxhash64("name"), F.lit(16)).cast("int").alias("part"))
    b = c.select(F.col("name").alias("subreddit_b"), "component", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("part"))
    return a.join(b, ["component", "part"]).filter(F.col("subreddit_a") < F.col("subreddit_b")).select("subreddit_a", "subreddit_b")


def p3_splits(spark: SparkSession, d: str) -> DataFrame:
    """Every record with its component and split; a record without keys is a component of its own."""
    keys = _keys(spark, d)
    own = F.concat_ws(":", F.lit("r"), "tbl", F.col("rec_id").cast("string"))
    keyed = keys.select("tbl", "rec_id", F.coalesce(grouping.group_node(F.col("community"), F.col("post")), own).alias("node"))
    placed = keyed.join(grouping.group_components(keys.select("community", "post")), "node", "left").select("tbl", "rec_id", F.coalesce("component", "node").alias("component"))
    sizes = placed.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    return placed.join(grouping.assign_splits(sizes, PROPORTIONS), "component").select("tbl", "rec_id", "component", "split")


def p4_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Every record of dpo_final (both branches) and documents with its characters and estimated tokens."""
    turn = "array<struct<content:string>>"
    texts = F.concat(*[F.coalesce(F.from_json(c, turn), F.array().cast(turn)) for c in ("chosen_branch", "rejected_branch")])
    keys = [source_key("source").alias("source"), language_key("lang").alias("lang"), community_key("subreddit").alias("community")]
    pairs = table(spark, d, "dpo_final").select(F.lit("dpo_final").alias("tbl"), F.col("pair_id").alias("rec_id"), *keys, texts["content"].alias("texts"))
    docs = table(spark, d, "documents").select(F.lit("documents").alias("tbl"), F.col("doc_id").alias("rec_id"), *keys, F.array("text").alias("texts"))
    both = pairs.unionByName(docs)
    chars = F.aggregate("texts", F.lit(0).cast("long"), lambda n, t: n + F.coalesce(F.length(t), F.lit(0)))
    return both.select("tbl", "rec_id", "source", "lang", "community", chars.alias("chars"), budget.token_counts(F.col("texts"), f"{TOKENIZERS}/piece_bpe_32k.model").alias("tokens"))


def p4_totals(spark: SparkSession, d: str) -> DataFrame:
    """Totals per table, source, language and community."""
    return budget.totals(p4_tokens(spark, d), ["tbl", "source", "lang", "community"])


def p5_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every record with its score, the label, turn and nearest labelled example of its worst turn."""
    own = [("sft_chains_scored", "chain_id", "turns"), ("dpo_final", "pair_id", "chosen_branch")]
    a, b = (table(spark, d, t).select(F.lit(t).alias("tbl"), F.col(i).alias("rec_id"), source_key("source").alias("source"), F.col(c).alias("conversation"), language_key("lang").alias("lang")) for t, i, c in own)
    both = a.unionByName(b)
    index = abuse.read_index(table(spark, d, "abuse_examples"), "example_id", "text", "label", table(spark, d, "abuse_terms"), corpus=both)
    return abuse.score_conversations(both, index, "rec_id", "conversation", ("tbl", "source"), "lang")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Records with abusive, hateful or sexual content."""
    return p5_scores(spark, d).filter(F.col("score") >= abuse.AFFECTED).select("tbl", "rec_id").distinct()


def p5_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rows, affected rows and rate per table and source."""
    bad = F.col("score") >= abuse.AFFECTED
    return p5_scores(spark, d).groupBy("tbl", "source").agg(F.count(F.lit(1)).alias("rows"), F.count_if(bad).alias("affected"), F.avg(bad.cast("double")).alias("rate"))


def _personal(spark: SparkSession, d: str) -> DataFrame:
    own = [("sft_chains_scored", "chain_id", "turns"), ("dpo_final", "pair_id", "fork")]
    a, b = (table(spark, d, t).select(F.lit(t).alias("tbl"), F.col(i).alias("rec_id"), F.col(c).alias("conversation")) for t, i, c in own)
    return a.unionByName(b)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Turns that hold personal data, by kind."""
    return personal.find_personal(_personal(spark, d), "rec_id", "conversation", ("tbl",)).distinct()


def p6_redacted(spark: SparkSession, d: str) -> DataFrame:
    """All conversations with personal data replaced by typed placeholders."""
    return personal.redact_conversations(_personal(spark, d), "conversation")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Defective branches of dpo_final with their defect."""
    pairs = table(spark, d, "dpo_final")
    labelled = table(spark, d, "documents").select("text", language_key("lang").alias("lang"))
    turn = "array<struct<content:string>>"
    none = F.array().cast(turn)
    each = F.concat(*[F.coalesce(F.from_json(c, turn), none) for c in ("fork", "chosen_branch", "rejected_branch")])
    model = defects.fit(labelled, pairs.select(F.col("pair_id").alias("key"), each["content"].alias("texts")))
    return defects.find_defects(pairs, model, "pair_id", "fork", {"chosen": "chosen_branch", "rejected": "rejected_branch"}).distinct()


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of every document by byte_bpe_50k."""
    return tokenizer.encode_corpus(table(spark, d, "documents"), "doc_id", "text", f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the held-out items that leaked into them."""
    return leakage.find_leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "heldout_items"), "item_id", "passage").select("doc_id", "item_id")


def p9_items(spark: SparkSession, d: str) -> DataFrame:
    """Leaked items with their documents and the most words found in one."""
    got = leakage.find_leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "heldout_items"), "item_id", "passage")
    return got.groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.max("words").alias("most_words"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents decoded with a wrong encoding, wholly or in part."""
    return garbled.mark_garbled(table(spark, d, "documents"), "doc_id", "text").filter("affected").select("doc_id").distinct()


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    """Affected documents with their text restored as far as possible."""
    return garbled.mark_garbled(table(spark, d, "documents"), "doc_id", "text").filter("affected").select("doc_id", "restored", "spans")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_contributors, p2_found, p2_report, p3_found, p3_splits, p4_tokens, p4_totals, p5_found, p5_scores, p5_rates, p6_found, p6_redacted, p7_found, p8_ids, p9_found, p9_items, p10_found, p10_restored)
}

_CONTRIBUTOR = r"""coalesce('c:' || nullif(regexp_replace(regexp_replace(lower(regexp_replace(subreddit, '\s+', '', 'g')), '^/*r/+', ''), '/+', '', 'g'), ''),
 's:' || nullif(regexp_replace(lower(source), '[^a-z0-9]+', '', 'g'), ''), 'none')"""
_MARKED = f"""with p as (select pair_id, {_CONTRIBUTOR} as contributor,
 case when isnan(score_delta) then null else score_delta end as s from dpo_final),
m as (select *, row_number() over (partition by contributor order by s desc nulls last, pair_id)
 <= (select count(*) // 50 from dpo_final) as kept from p)"""

ORACLE: dict[str, str] = {
    "p1_found": f"{_MARKED} select pair_id from m where not kept",
    "p1_contributors": f"{_MARKED} select contributor, count(*) filter (kept) as kept, count(*) filter (not kept) as removed from m group by contributor",
}
