"""Evaluation rows, one per sample with a map of its results by model label, and the answers that were right.

Flat rows (id, label, ...) are the working form; the nested one is what is kept between runs. Labels are a short list, so a sample's
results fit its row. Within a map labels stand in the order in which they came."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a right answer is kept with, and the result field that it comes from.
CLEAN_FIELDS = {
    "model_name": "model_name", "thinking": "thinking_raw", "answer": "prediction_raw", "answer_extracted": "prediction_extracted", "latency_sec": "latency_sec",
    "ttft_sec": "ttft_sec", "gen_speed_tps": "gen_speed_tps", "prompt_tokens": "prompt_tokens", "completion_tokens": "completion_tokens",
}


def nested(flat: DataFrame, sample_cols: list[str], ordinal: str, id_col: str = "id", label_col: str = "model_label") -> DataFrame:
    """A row per id: ``sample_cols`` of its first row, and ``results``, a map from label to all other columns. Of rows that share
    id and label the last one counts, in the place of the first; rows without id or label are dropped."""
    rest = [c for c in flat.columns if c not in (id_col, ordinal, *sample_cols)]
    present = flat.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    by_label = present.groupBy(id_col, label_col).agg(
        F.min(ordinal).alias("__first"), F.max_by(F.struct(*rest), F.col(ordinal)).alias("__result"), F.min_by(F.struct(*sample_cols), F.col(ordinal)).alias("__sample")
    )
    entries = F.transform(F.array_sort(F.collect_list(F.struct("__first", F.col(label_col).alias("__label"), "__result"))), lambda x: F.struct(x["__label"], x["__result"]))
    rows = by_label.groupBy(id_col).agg(F.min_by("__sample", "__first").alias("__sample"), F.map_from_entries(entries).alias("results"))
    return rows.select(id_col, "__sample.*", "results")


def flattened(rows: DataFrame, sample_cols: list[str], id_col: str = "id") -> DataFrame:
    """A row per id and label again."""
    return rows.select(id_col, *sample_cols, F.explode("results").alias("__label", "__result")).select(id_col, *sample_cols, "__result.*")


def _upserted(old: Column, new: Column) -> Column:
    """The entries of both maps; where a label is in both, the new result in the old one's place."""
    kept = F.transform(F.map_entries(old), lambda e: F.struct(e["key"].alias("key"), F.coalesce(F.try_element_at(new, e["key"]), e["value"]).alias("value")))
    added = F.filter(F.map_entries(new), lambda e: ~F.map_contains_key(old, e["key"]))
    return F.map_from_entries(F.concat(kept, added))


def merged(old: DataFrame, new: DataFrame, sample_cols: list[str], id_col: str = "id") -> DataFrame:
    """Nested rows of both runs. A new result replaces that of its label; a sample that is known keeps its columns. Merging the same rows again changes nothing."""
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, F.col(f"o.{id_col}") == F.col(f"n.{id_col}"), "full_outer")
    results = F.when(F.col("o.results").isNull(), F.col("n.results")).when(F.col("n.results").isNull(), F.col("o.results")).otherwise(_upserted(F.col("o.results"), F.col("n.results")))
    known = F.col(f"o.{id_col}").isNotNull()
    columns = [F.when(known, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c) for c in sample_cols]
    return both.select(F.coalesce(f"o.{id_col}", f"n.{id_col}").alias(id_col), *columns, results.alias("results"))


def clean_answers(rows: DataFrame, sample_cols: list[str], id_col: str = "id", fields: dict[str, str] = CLEAN_FIELDS) -> DataFrame:
    """Of nested rows the samples that some model got right, with ``correct_models``: each such model and ``fields`` of its result."""
    right = F.filter(F.map_entries("results"), lambda e: F.coalesce(e["value"]["correct"], F.lit(False)))
    models = F.transform(right, lambda e: F.struct(e["key"].alias("model"), *[e["value"][source].alias(name) for name, source in fields.items()]))
    return rows.select(id_col, *sample_cols, models.alias("correct_models")).filter(F.size("correct_models") > 0)


def merged_answers(old: DataFrame, new: DataFrame, sample_cols: list[str], id_col: str = "id") -> DataFrame:
    """Clean answers of both runs: a model that has one for a sample keeps it, others are added behind."""
    both = old.alias("o").join(new.alias("n"), F.col(f"o.{id_col}") == F.col(f"n.{id_col}"), "full_outer")
    have, come = F.col("o.correct_models"), F.col("n.correct_models")
    added = F.filter(come, lambda m: ~F.exists(have, lambda k: k["model"] == m["model"]))
    models = F.when(have.isNull(), come).when(come.isNull(), have).otherwise(F.concat(have, added))
    known = F.col(f"o.{id_col}").isNotNull()
    columns = [F.when(known, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c) for c in sample_cols]
    return both.select(F.coalesce(f"o.{id_col}", f"n.{id_col}").alias(id_col), *columns, models.alias("correct_models"))
