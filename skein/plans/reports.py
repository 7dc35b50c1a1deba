"""What a training run and a blocking run say: tables, plain text, a plot where matplotlib is installed, and projections to full size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features, filtering, metrics
from ..sources import files


def _rows(df: DataFrame) -> list[dict]:
    """All rows of a table of thresholds, rules, sources or the like: a few dozen."""
    return [r.asDict() for r in df.collect()]


def importance_rows(gains: Sequence[tuple[str, float, int]]) -> list[dict]:
    """(feature, gain, split) as rows with the share in all gain, the rank, the feature's group, and whether it needs embeddings."""
    group = {f: g for g, fs in features.FEATURE_GROUPS.items() for f in fs}
    total = sum(g for _, g, _ in gains) or 1.0
    ordered = sorted(gains, key=lambda x: (-x[1], x[0]))
    return [{"feature": f, "gain": g, "split": n, "gain_pct": 100 * g / total, "gain_rank": i, "group": group.get(f, ""), "dense_derived": f in features.DENSE_DERIVED} for i, (f, g, n) in enumerate(ordered, 1)]


def training(scored: DataFrame, truth: DataFrame, importance: list[dict], top_k: int, floor: float, no_match: float) -> dict:
    """scored: q, p, score, label, from models that did not see the pair; truth: (q, n_true) of the same queries."""
    chosen = filtering.keep_top(scored, top_k, floor, no_match)
    n_true = int(truth.agg(F.sum("n_true")).first()[0] or 0)
    by_group: dict[str, float] = {}
    for r in importance:
        by_group[r["group"]] = by_group.get(r["group"], 0.0) + r["gain_pct"]
    pairs, entities = (_rows(t.orderBy("threshold")) for t in (metrics.pair_threshold_table(scored, n_true), metrics.entity_threshold_table(scored, truth)))
    final = {r["threshold"]: r["macro_f05"] for r in entities}
    return {
        **metrics.class_balance(scored).first().asDict(), **metrics.average_precision(scored).first().asDict(),
        "thresholds": [r | {"macro_f05_if_final": final.get(r["threshold"])} for r in pairs],
        "recall_ceiling": round((scored.agg(F.sum("label")).first()[0] or 0) / max(n_true, 1), 4),
        "filter_sweep": _rows(filtering.filter_sweep(scored, truth)),
        "filter_chosen": {"top_k": top_k, "floor": floor, "no_match": no_match} | filtering.filter_stats(chosen.where("keep"), truth).first().asDict(),
        "lost": filtering.loss_attribution(scored, chosen.where("keep"), truth).first().asDict(),
        "matches_per_query": _rows(filtering.match_histogram(truth).orderBy("matches")),
        "importance_by_group_pct": {g: round(x, 2) for g, x in by_group.items()},
        "dense_derived_gain_pct": round(sum(r["gain_pct"] for r in importance if r["dense_derived"]), 2),
    }


def _table(rows: list[dict]) -> list[str]:
    if not rows:
        return []
    cells = [list(rows[0]), *([f"{v:.4f}" if isinstance(v, float) else str(v) for v in r.values()] for r in rows)]
    width = [max(len(c[i]) for c in cells) for i in range(len(cells[0]))]
    return ["  " + "  ".join(v.rjust(w) for v, w in zip(c, width)) for c in cells]


def text(title: str, said: dict) -> str:
    """A report for people: numbers as lines, lists of rows as tables."""
    out = [title, "=" * len(title)]
    for k, v in said.items():
        if isinstance(v, list) and v and isinstance(v[0], dict):
            out += ["", k, *_table(v)]
        elif isinstance(v, dict):
            out += ["", k, *(f"  {a}: {b}" for a, b in v.items())]
        else:
            out.append(f"{k}: {v}")
    return "\n".join(out) + "\n"


def write_text(spark: SparkSession, said: str, path: str) -> None:
    spark.createDataFrame([(said,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def plot_pr(thresholds: list[dict], path: str, chosen: float) -> bool:
    """Precision by recall, and all three measures by threshold, as an image on the driver; False if matplotlib is not installed."""
    try:
        import matplotlib
    except ModuleNotFoundError:
        return False
    matplotlib.use("Agg")
    from matplotlib import pyplot

    fig, (left, right) = pyplot.subplots(1, 2, figsize=(10, 4))
    column = lambda c: [r[c] for r in thresholds]
    left.plot(column("recall"), column("precision"), marker="o")
    left.set(xlabel="recall", ylabel="precision")
    for c in ("precision", "recall", "f05"):
        right.plot(column("threshold"), column(c), label=c)
    right.axvline(chosen, linestyle="--")
    right.set(xlabel="threshold")
    right.legend()
    fig.savefig(path)
    pyplot.close(fig)
    return True


def projected_pairs(spark: SparkSession, sources: dict[str, str], per_query: dict[str, float]) -> dict[str, dict]:
    """For each split with a full source file: its queries, pairs a query as seen here (test: as in val), and the pairs to expect."""
    seen = per_query | ({"test": per_query["val"]} if "val" in per_query else {})
    n = {split: files.read_tsv(spark, path).count() for split, path in sources.items() if split in seen}
    return {split: {"s1": n[split], "pairs_per_s1": round(seen[split], 3), "pairs": int(n[split] * seen[split])} for split in n}


def cost(full: dict[str, dict], per_second: dict[str, float], price_per_hour: float, epochs: int = 1, dev_share: float = 0.1, evals: int = 1, spread: tuple[float, float] = (0.5, 1.5)) -> dict:
    """Hours and price of the second scorer at full size. full: projected_pairs; per_second: pairs by "train" and "infer"."""
    train = full.get("train", {}).get("pairs", 0)
    dev, score = train * dev_share, sum(full.get(s, {}).get("pairs", 0) for s in ("val", "test"))
    seconds = {"train": (train - dev) * epochs / per_second["train"], "dev_evals": dev * evals * epochs / per_second["infer"], "score": score / per_second["infer"]}
    hours = sum(seconds.values()) / 3600
    low, high = (round(hours / s, 2) for s in reversed(spread))
    return {"hours": {k: round(v / 3600, 2) for k, v in seconds.items()} | {"total": round(hours, 2), "range": [low, high]}, "price": {"an_hour": price_per_hour, "total": round(hours * price_per_hour, 2)}}


def accelerator_rate(parameters: float, tokens: float, tflops: float = 70.0, use: float = 0.25, frozen: bool = False) -> dict[str, float]:
    """Pairs a second by floating-point operations: 6 a parameter and token to train (4 with frozen weights), 2 to score."""
    power = tflops * 1e12 * use / (parameters * tokens)
    return {"train": round(power / (4 if frozen else 6), 1), "infer": round(power / 2, 1)}
