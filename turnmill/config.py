"""Settings of the loaders: defaults, a profile over them, and the overlay for preference pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from turnmill.operators import pairs, split, weights
from turnmill.sources.tables import non_empty, scan

#: Settings of the pair loader that a ``dpo`` section overrides after the profile.
PAIR_KEYS = ("weight_beta", "weight_mode", "min_score_delta", "chosen_weighting", "test_split", "seed")


def overlaid(config: dict, profile: str | None = None, model: str | None = None) -> dict:
    """``config`` with the sections of ``config["profiles"][profile]`` laid over it, and the name of a model preset.

    Values of a profile that are no section go into ``training``. ``KeyError`` for an unknown profile, ``ValueError`` for an
    unknown ``model``.
    """
    out = {k: dict(v) if isinstance(v, dict) else v for k, v in config.items() if k != "profiles"}
    for section, values in (config.get("profiles", {})[profile] if profile else {}).items():
        if isinstance(values, dict):
            out[section] = {**out.get(section, {}), **values}
        else:
            out["training"] = {**out.get("training", {}), section: values}
    if model:
        presets = config.get("model_presets", {})
        if model not in presets:
            raise ValueError(f"no model preset {model!r}")
        out["model"] = {**out.get("model", {}), "name": presets[model]["name"]}
    return out


def load_config(path: str, profile: str | None = None, model: str | None = None) -> dict:
    """A YAML file, where a YAML reader is installed, else JSON."""
    with open(path) as f:
        try:
            import yaml
        except ImportError:
            import json

            return overlaid(json.load(f), profile, model)
        return overlaid(yaml.safe_load(f), profile, model)


def load_sft(spark: SparkSession, path: str, key: str, min_chain_depth: int = 3, min_total_score: float = 0.0, weight_beta: float = 0.3, weight_mode: str = "gate_amplify", weight_floor: float = 0.1, weight_max: float | None = 3.0, test_split: float = 0.05, seed: int = 42) -> DataFrame:
    """Training rows with normalised ``turn_weights`` and ``is_test``. Statistics are those of all rows, before the split."""
    rows = non_empty(pairs.sft_rows(scan(spark, path), min_chain_depth, min_total_score, beta=weight_beta, mode=weight_mode, floor=weight_floor))
    return split.train_test(weights.normalise_turn_weights(rows, most=weight_max), key, test_split, seed)


def load_dpo(spark: SparkSession, path: str, key: str, min_score_delta: float = 0.0, matched_only: bool = True, chosen_weighting: bool = False, weight_beta: float = 0.3, weight_mode: str = "gate_amplify", weight_floor: float = 0.1, weight_max: float | None = 2.0, test_split: float = 0.05, seed: int = 42) -> DataFrame:
    """The same for preference pairs, with ``chosen_weight`` where weighting is on."""
    rows = non_empty(pairs.dpo_rows(scan(spark, path), min_score_delta, matched_only, chosen_weighting, beta=weight_beta, mode=weight_mode, floor=weight_floor))
    return split.train_test(weights.normalise_weight(rows, most=weight_max) if chosen_weighting else rows, key, test_split, seed)


def load_from_config(spark: SparkSession, config: dict, key: str, pair: bool = False) -> DataFrame:
    """``load_sft`` or ``load_dpo`` by the ``data`` section (and ``dpo``, laid over it for pairs)."""
    data = {**config.get("data", {}), **({k: v for k, v in config.get("dpo", {}).items() if k in (*PAIR_KEYS, "data_path")} if pair else {})}
    load = load_dpo if pair else load_sft
    known = load.__code__.co_varnames[: load.__code__.co_argcount]
    return load(spark, data["data_path"], key, **{k: v for k, v in data.items() if k in known[3:]})
