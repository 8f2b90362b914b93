"""Token-level operators: masks, weights, losses and the checks of encoded pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MASKED = -100


def token_weights(df: DataFrame, key: str, labels: str, weights: str) -> DataFrame:
    """(key, pos, label, weight): each token of the k-th unmasked run has the k-th positive weight, beyond them 1; masked ones 0."""
    flat = df.select(key, F.filter(weights, lambda w: w > 0).alias("w"), F.posexplode(labels).alias("pos", "label"))
    by = Window.partitionBy(key).orderBy("pos")
    on = F.col("label") != MASKED
    start = (on & (F.coalesce(F.lag("label").over(by), F.lit(MASKED)) == MASKED)).cast("int")
    run = flat.withColumn("start", start).withColumn("run", F.sum("start").over(by))
    weight = F.when(on, F.coalesce(F.try_element_at("w", F.greatest(F.col("run").cast("int"), F.lit(1))), F.lit(1.0))).otherwise(F.lit(0.0))
    return run.select(key, "pos", "label", weight.alias("weight"))


def weighted_loss(df: DataFrame, batch: str, loss: str, weight: str) -> DataFrame:
    """Weighted mean loss of each batch; a weight sum below 1 counts as 1."""
    return df.groupBy(batch).agg((F.sum(F.col(loss) * F.col(weight)) / F.greatest(F.sum(weight), F.lit(1.0))).alias("loss"))


def shifted(df: DataFrame, key: str) -> DataFrame:
    """``df`` with ``target``: the label at the next position, masked at the end."""
    return df.withColumn("target", F.coalesce(F.lead("label").over(Window.partitionBy(key).orderBy("pos")), F.lit(MASKED)))


def masked_accuracy(df: DataFrame, predicted: str = "predicted", label: str = "label", *by: str) -> DataFrame:
    """Share of right predictions among unmasked labels; 0 where there are none."""
    on = F.col(label) != MASKED
    hit = F.count_if(on & (F.col(predicted) == F.col(label)))
    return df.groupBy(*by).agg(F.coalesce(hit / F.nullif(F.count_if(on), F.lit(0)), F.lit(0.0)).alias("accuracy"))


def batch_loss(df: DataFrame, batch: str, loss: str, weight: str) -> DataFrame:
    """Mean loss of a batch times its mean weight."""
    return df.groupBy(batch).agg((F.avg(loss) * F.avg(weight)).alias("loss"))


def whitespace_ids(turns: Column, prompt: bool = False) -> Column:
    """Tokens of a conversation under a stand-in tokenizer and template: role marks and words, here as strings.

    A real tokenizer takes its place as a function from an array of turns to an array of tokens.
    """
    each = F.transform(turns, lambda t: F.concat(F.array(F.concat(F.lit("<"), F.coalesce(t["role"], F.lit("")), F.lit(">"))), F.filter(F.split(F.coalesce(t["content"], F.lit("")), r"\s+"), lambda w: w != ""), F.array(F.lit("</s>"))))
    flat = F.flatten(each)
    return F.concat(flat, F.array(F.lit("<assistant>"))) if prompt else flat


def starts_with(full: Column, fork: Column) -> Column:
    """Whether the tokens of the fork are a prefix of the whole."""
    return (F.size(full) >= F.size(fork)) & (F.slice(full, 1, F.size(fork)) == fork)


def rendered(turns: Column, encode=whitespace_ids) -> Column:
    """A conversation as text: its tokens with blanks between them."""
    return F.array_join(encode(turns), " ")


def branch_checks(df: DataFrame, key: str, max_length: int = 512, encode=whitespace_ids) -> DataFrame:
    """(key, branch, check, status, truncated): OK, WARN or FAIL of each check of both branches of typed pairs.

    Null arrays count as empty. The fork is encoded with the prompt for an answer, fork and branch without it and cut to
    ``max_length``. The checks: the fork's tokens are a prefix; both branches share them; a response is left after the cut;
    it ends on the end mark; the last role is assistant or user; the tokens are those of the text written out and read again
    (or were cut); the roles alternate.
    """
    from turnmill.functions import turns as tf

    none = F.array().cast(df.schema["fork"].dataType)
    both = df.select(key, F.coalesce("fork", none).alias("fork"), F.explode(F.create_map(F.lit("chosen"), F.coalesce("chosen_branch", none), F.lit("rejected"), F.coalesce("rejected_branch", none))).alias("branch", "turns"))
    whole = F.concat("fork", "turns")
    x = both.select(key, "branch", encode(F.col("fork"), True).alias("f"), encode(whole).alias("w"), rendered(whole, encode).alias("text"), tf.last_role(F.col("turns")).alias("last"), tf.alternates(whole).alias("alt"))
    x = x.withColumn("cut", F.slice("w", 1, max_length)).withColumn("truncated", F.size("w") > max_length)
    status = lambda ok, bad: F.when(ok, "OK").otherwise(bad)
    again = F.filter(F.split("text", " "), lambda w: w != "")
    checks = {
        "prefix": status(starts_with(F.col("cut"), F.col("f")), "FAIL"),
        "shared": F.lit("OK"),
        "response": status(F.size("cut") > F.size("f"), "FAIL"),
        "end": status(F.coalesce(F.try_element_at("cut", F.lit(-1)) == "</s>", F.lit(False)), "WARN"),
        "last_role": status(F.col("last").isin("assistant", "user"), "WARN"),
        "stable": status(F.col("truncated") | (again == F.col("w")), "WARN"),
        "alternation": status(F.col("alt"), "WARN"),
    }
    return x.select(key, "branch", "truncated", F.explode(F.array(*[F.struct(F.lit(k).alias("check"), v.alias("status")) for k, v in checks.items()])).alias("c")).select(key, "branch", "c.*", "truncated")
