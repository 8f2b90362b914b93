import json

from pyspark.sql import functions as F

from turnmill import cli
from turnmill.schemas import PAIR_COLUMNS
from turnmill.sources import tables


def test_score_swap_inspect_preview(spark, tiny, tmp_path, capsys):
    out = str(tmp_path / "scored.parquet")
    assert cli.main(["score", "--data-dir", f"{tiny}/sft_chains_scored.parquet", "--output-path", out, "--key", "chain_id"]) == 0
    got, raw = tables.scan(spark, out), tables.scan(spark, f"{tiny}/sft_chains_scored.parquet")
    assert got.count() == raw.count() and set(got.columns) == set(raw.columns)
    legacy = str(tmp_path / "legacy.parquet")
    assert cli.main(["score", "--data-dir", f"{tiny}/legacy_pairs.parquet", "--output-path", legacy, "--key", "legacy_id"]) == 0
    swapped = str(tmp_path / "swapped.parquet")
    assert cli.main(["swap", "--input", f"{tiny}/dpo_final.parquet", "--output", swapped]) == 0
    ends = tables.scan(spark, swapped).select(F.element_at(F.from_json("fork", "array<struct<role:string>>"), -1)["role"].alias("r")).filter("r = 'assistant'")
    assert ends.count() == 0
    before = tables.scan(spark, swapped).count()
    assert cli.main(["swap", "--input", swapped, "--in-place"]) == 0 and tables.scan(spark, swapped).count() == before
    assert cli.main(["inspect", "--data-path", swapped, "--source", "reddit"]) == 0
    report = tmp_path / "report.txt"
    assert cli.main(["inspect", "--data-path", swapped, "--samples", "3", "--max-rows", "50", "--out", str(report)]) == 0
    assert report.read_text().count("\n-- [") == 3 and "== sources" in report.read_text()
    made = str(tmp_path / "made.parquet")
    assert cli.main(["generate", "--data-dir", f"{tiny}/dpo_final.parquet", "--output-path", made, "--key", "pair_id", "--generator", "turnmill.operators.rewrite:echo_generator"]) == 0
    assert tables.scan(spark, made).columns == PAIR_COLUMNS and tables.scan(spark, made).count() > 0
    assert cli.main(["preview", "--data-path", swapped, "--key", "pair_id", "--samples", "2"]) == 0
    assert cli.main(["preview", "--data-path", swapped, "--key", "pair_id", "--strict"]) in (0, 2)
    assert cli.main(["inspect", "--data-path", str(tmp_path / "none")]) == 1
    assert json.loads(tables.scan(spark, swapped).filter("fork is not null").first().fork) is not None
