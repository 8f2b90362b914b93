"""Command line: score, swap, inspect, rewrite-free checks and splits of conversation data.

    python -m turnmill.cli score --data-dir IN --output-path OUT --key chain_id
    python -m turnmill.cli swap --input IN (--output OUT | --in-place | --dry-run)
    python -m turnmill.cli inspect --data-path IN [--source S] [--subreddit S] [--post-id P] [--synthetic-only] [--untouched-only] [--max-rows N] [--samples N] [--seed N] [--print-all] [--out FILE]
    python -m turnmill.cli preview --data-path IN --key pair_id [--max-length N] [--strict] [--scan-all] [--no-color] [as inspect]
    python -m turnmill.cli generate --data-dir IN --output-path OUT --key pair_id --generator module:function [--keep-unmatched] [--no-skip-matched]
"""

from __future__ import annotations

import argparse
import contextlib
import importlib
import sys

from pyspark.sql import functions as F

from turnmill.functions import text, turns
from turnmill.operators import pairs, report, rewrite, scoring, tokens
from turnmill.session import build_session, checkpointed
from turnmill.sources import sinks, tables

#: The order in which rows lie in their files.
FILE_ORDER = ["_metadata.file_path", "_metadata.row_index"]


def score(spark, a) -> int:
    df = tables.scan(spark, a.data_dir)
    sft = tables.detect_format(df) == "sft"
    talk = turns.decode("turns") if sft else scoring.boundary_pairs(F.col("prompt"), F.col("chosen"))
    scores = scoring.turn_alignment(df, a.key, talk)
    report.score_summary(scoring.chain_alignment(df, a.key, scores)).show(truncate=False)
    sinks.write(scoring.embed_alignment(df.drop("attunement_score"), a.key, scores, "turns" if sft else None), a.output_path)
    return 0


def generate(spark, a) -> int:
    """The rewriting of pairs; ``--generator`` names a function as ``module:function``."""
    module, _, name = a.generator.partition(":")
    writer = getattr(importlib.import_module(module), name)
    df = tables.non_empty(tables.scan(spark, a.data_dir), "the pairs")
    df = pairs.select_pairs(df, limit=a.max_rows, order=FILE_ORDER)
    out = checkpointed(rewrite.rewrite_all(df, a.key, writer, a.score_threshold, a.length_tolerance, not a.no_skip_matched))
    rewrite.run_summary(out, a.keep_unmatched).show(truncate=False)
    sinks.write(pairs.assemble(out if a.keep_unmatched else out.filter("length_matched")), a.output_path)
    return 0


def swap(spark, a) -> int:
    df = tables.scan(spark, a.input)
    where = turns.ends_on_assistant(turns.decode("fork"))
    pairs.swap_statistics(df.select(where.alias("swapped"))).show()
    if a.dry_run:
        return 0
    if not (a.output or a.in_place):
        print("give --output, --in-place or --dry-run", file=sys.stderr)
        return 0
    # all three arrays by the fork as it was
    marked = df.withColumn("__swap", where)
    out = marked.withColumns({c: sinks.swap_roles_exact(c, F.col("__swap")) for c in ("fork", "chosen_branch", "rejected_branch")})
    out = sinks.with_schema(out, df.schema)
    sinks.replace(out, a.input) if a.in_place else sinks.write(out, a.output)
    return 0


def _selected(spark, a):
    df = tables.scan(spark, a.data_path)
    return pairs.select_pairs(df, a.source, a.subreddit, a.post_id, a.synthetic_only, a.untouched_only, a.max_rows, FILE_ORDER)


def _print_samples(raw, a, colour: bool = False) -> None:
    """A seeded sample of pairs, turn by turn; contents are cut unless ``--print-all``."""
    df = raw.withColumn("__n", F.xxhash64(F.lit(a.seed), *raw.columns)).orderBy("__n").limit(a.samples)
    show = (lambda c: c) if a.print_all else (lambda c: text.shown(c, 300))
    said = lambda c: F.transform(turns.decode(c), lambda t: F.concat(F.lit("["), F.coalesce(t["role"], F.lit("?")), F.when(t["synthetic"], "*").otherwise(""), F.lit("] "), F.coalesce(show(t["content"]), F.lit(""))))
    kept = [c for c in ("source", "subreddit", "post_id", "score_delta") if c in raw.columns]
    for r in df.select(*kept, pairs.touched(raw).alias("touched"), *[said(c).alias(c) for c in ("fork", "chosen_branch", "rejected_branch")]).collect():
        print("-- " + ("[synthetic] " if r["touched"] else "[natural] ") + " ".join(f"{c}={r[c]}" for c in kept))
        for c in ("fork", "chosen_branch", "rejected_branch"):
            masked = colour and c == "fork"
            for line in r[c] or ():
                print(f"  {c}: " + (f"\x1b[2m{line}\x1b[0m" if masked else f"\x1b[32m{line}\x1b[0m" if colour else line))


def inspect(spark, a) -> int:
    raw = _selected(spark, a)
    df = pairs.typed(raw)
    for name, got in {
        "sources": report.counts_by(raw, F.col("source"), "source").orderBy(F.desc("rows")), "communities": report.top_subreddits(raw), "posts": report.pairs_per_post(raw), "depths": report.depth_statistics(df),
        "fork depths": report.depth_distribution(raw).orderBy("fork_depth"), "scores": report.score_statistics(raw), "characters": report.char_statistics(df), "balance": report.length_balance(df),
        "balance of matched pairs": report.length_balance(df, True), "synthesis": report.synthesis_statistics(raw), "replacements": report.replacement_distribution(raw).orderBy("role", "replacements"), "replacements per pair": report.replacement_statistics(raw), "number of communities": report.community_count(raw), "synthetic turns": report.synthetic_flags(df), "tokens": report.token_estimate(df),
    }.items():
        print(f"== {name}")
        got.show(truncate=False)
    if a.samples:
        _print_samples(raw, a)
    return 0


def preview(spark, a) -> int:
    """Samples with the masked fork dimmed, then the checks of those pairs, or with ``--scan-all`` of all pairs."""
    raw = _selected(spark, a)
    if a.samples:
        _print_samples(raw, a, not a.no_color and not a.out)
    if a.samples and not a.scan_all:
        raw = raw.orderBy(F.xxhash64(F.lit(a.seed), *raw.columns)).limit(a.samples)
    checks = tokens.branch_checks(pairs.typed(raw), a.key, a.max_length)
    got = checkpointed(checks.groupBy("branch", "check", "status").agg(F.count(F.lit(1)).alias("pairs"), F.count_if("truncated").alias("truncated"))).orderBy("branch", "check", "status")
    got.show(50, truncate=False)
    return 2 if a.strict and not got.filter("status = 'FAIL'").isEmpty() else 0


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="turnmill")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("score")
    c.add_argument("--data-dir", required=True)
    c.add_argument("--output-path", required=True)
    c.add_argument("--key", required=True)
    c = sub.add_parser("swap")
    c.add_argument("--input", required=True)
    c.add_argument("--output")
    c.add_argument("--in-place", action="store_true")
    c.add_argument("--dry-run", action="store_true")
    c = sub.add_parser("generate")
    c.add_argument("--data-dir", required=True)
    c.add_argument("--output-path", required=True)
    c.add_argument("--key", required=True)
    c.add_argument("--generator", required=True)
    c.add_argument("--score-threshold", type=float, default=5.0)
    c.add_argument("--length-tolerance", type=float, default=0.30)
    c.add_argument("--max-rows", type=int, default=0)
    c.add_argument("--no-skip-matched", action="store_true")
    c.add_argument("--keep-unmatched", action="store_true")
    for name in ("inspect", "preview"):
        c = sub.add_parser(name)
        c.add_argument("--data-path", required=True)
        for o in ("--source", "--subreddit", "--post-id"):
            c.add_argument(o, default="")
        c.add_argument("--synthetic-only", action="store_true")
        c.add_argument("--untouched-only", action="store_true")
        c.add_argument("--max-rows", type=int, default=0)
        c.add_argument("--samples", type=int, default=0)
        c.add_argument("--seed", type=int, default=42)
        c.add_argument("--print-all", action="store_true")
        c.add_argument("--out", help="file that the report goes to")
        if name == "preview":
            c.add_argument("--key", required=True)
            c.add_argument("--scan-all", action="store_true")
            c.add_argument("--no-color", action="store_true")
            c.add_argument("--max-length", type=int, default=512)
            c.add_argument("--strict", action="store_true")
    a = p.parse_args(argv)
    run = {"score": score, "swap": swap, "generate": generate, "inspect": inspect, "preview": preview}[a.command]
    try:
        with contextlib.ExitStack() as stack:
            if getattr(a, "out", None):
                stack.enter_context(contextlib.redirect_stdout(stack.enter_context(open(a.out, "w", encoding="utf-8"))))
            return run(build_session("turnmill"), a)
    except FileNotFoundError as e:
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
