"""The four jobs: panel scores, sampled corpus, baseline, biographies.

Each is one lineage keyed by (task, chunk_index, id); no job loops over ids.
Trees of all (chunk, task), and boosters of all tasks, grow together.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import clean, evaluate, labels, models, panel, report, sampling, textrows, vocab
from ..operators.joins import fan_out
from ..sources.staging import stage


def binarized_panel(cells: DataFrame, n_rows: int | None = None, min_side: int = panel.MIN_SIDE) -> DataFrame:
    """Long panel -> gated 0/1 cells."""
    split = stage(panel.median_split(cells, n_rows, min_side=min_side), "split")
    return panel.binarize_cells(cells, split)


def panel_scores(
    cells: DataFrame,
    residuals: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    chunk_size: int = panel.CHUNK_SIZE,
    min_tail: int = panel.MIN_TAIL,
    n_rows: int | None = None,
) -> DataFrame:
    """Panel -> chunks -> binary rows as text -> scores -> R2 per (task, chunk).

    ``score`` turns (chunk_index, id, text, task) into rows with a score, so
    that every (task, chunk) can have its own model; the residuals are
    (id, task, prediction, truth, ybar_train).
    """
    profile = panel.usable_features(panel.column_profile(cells))
    chunks = stage(panel.feature_chunks(profile, chunk_size, min_tail), "chunks")
    # Read twice: once for the names of its features, and once for the texts.
    binary = binarized_panel(cells, n_rows)
    have = panel.select_available(chunks, binary.select("feature").distinct())
    texts = textrows.render_chunks(binary, "id", have)
    by_task = stage(fan_out(texts, residuals.select("id", "task"), ["id"], "tasks"), "task_texts")
    scores = score(by_task).select("chunk_index", "id", "task", "score")
    grid = evaluate.evaluate_grid(scores, residuals)
    return report.attach_chunks(grid, chunks)


def sampled_corpus(
    cells: DataFrame, key: str, n_samples: int = sampling.SAMPLES_PER_ID,
    min_features: int = sampling.MIN_FEATURES, max_features: int = sampling.MAX_FEATURES,
    seed: object = 0, together: bool = False,
) -> DataFrame:
    """Panel cells (key, ord, feature, value) -> one text line per sample."""
    # A cell is rendered once, not in each sample that takes it.
    shown = cells.select(key, "ord", "feature", "value", tx.cell_text(F.col("feature"), F.col("value"), "plain").alias("shown"))
    drawn = sampling.feature_subsets(shown, key, n_samples, min_features, max_features, seed, ["shown"], together)
    return textrows.render_samples(drawn, key, "plain", "shown")


def encoded_corpus(
    texts: DataFrame, key: Sequence[str], vocab_size: int = vocab.VOCAB_SIZE,
    max_length: int = vocab.MAX_LENGTH, test_size: float = 0.05, split_key: Sequence[str] | None = None,
    seed: object = 0,
) -> DataFrame:
    """Texts -> vocabulary -> encoded rows, split by key and masked."""
    words = stage(vocab.top_vocab(vocab.token_counts(texts), vocab_size), "vocab")
    encoded = vocab.encode(texts, key, words, max_length)
    masked = vocab.mlm_mask(encoded, key, vocab_size, seed=seed)
    return sampling.hash_split(masked, list(split_key or key[:1]), test_size, seed)


def baseline_features(background: DataFrame, proxy: Sequence[str] = clean.GPA_PROXY_COLUMNS) -> DataFrame:
    """Coded background columns -> the features of the linear baseline."""
    codes_filled = clean.impute_mode(background, ["cm1ethrace", "cm1relf"])
    filled = clean.impute_mean(codes_filled, ["cm1edu"])
    race = clean.add_indicators(filled, "cm1ethrace", clean.RACE_CODES, clean.RACE_OTHERS)
    both = clean.add_indicators(race, "cm1relf", clean.MARITAL_CODES, clean.MARITAL_OTHERS)
    return clean.proxy_feature(both, proxy).select(*clean.BASELINE_COLUMNS, "gpa_proxy")


def linear_baseline(
    features: DataFrame, train: DataFrame, test: DataFrame, key: str, task: str,
    columns: Sequence[str], include_id: bool = False,
) -> DataFrame:
    """Fit on the training outcomes, predict the test ids: (key, truth, prediction)."""
    train_rows = clean.label_join(train, features, key, task)
    test_rows = clean.label_join(test, features, key, task)
    model = models.ols(train_rows, columns, task, key, include_id)
    cols = [*columns, key] if include_id else list(columns)
    scored = models.predict(model, test_rows, cols)
    return scored.select(key, F.col(task).alias("truth"), "prediction")


def life_span_pairs(records: DataFrame, seed: object = 42, template: str = "persons") -> DataFrame:
    """Nested biographies (with a ``rec_id``) -> balanced comparison pairs."""
    labelled = clean.drop_outliers(textrows.labelled_texts(records), "label")
    return textrows.pair_rows(labelled, "rec_id", "masked_text", "label", seed, template)


def corrected_by_boosting(
    train: DataFrame, test: DataFrame, residuals: DataFrame, features: Sequence[str],
    rounds: int = models.BOOST_ROUNDS,
) -> DataFrame:
    """Boost chunk predictions into a residual, one booster per task, and compare R2 with and without it.

    ``train`` is (id, task, diff, features...), ``test`` (id, task, features...).
    A task without training rows gets no booster and is not scored; a null
    feature is an error.
    """
    _, scored = models.boosted_correction(train, test, features, rounds)
    scored = scored.where("predicted_diff is not null").select("id", "task", "predicted_diff")
    joined = labels.attach_by_id(residuals, stage(scored, "boosted"), ["id", "task"])
    return evaluate.compare_with_baseline(joined, ["task"], {"boosted": "predicted_diff"})
