"""Registered queries over the driver's tables: events as trajectories, embeddings as window vectors, labelled documents as predictions, customers as registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from phaseloom.functions import distributions as D
from phaseloom.operators import audit, corpus, grounding, hmm, metrics, models, registry, sampling, trajectory, vectors
from phaseloom.session import checkpointed, table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    from phaseloom.plans import assistant, choices, contexts, scoring, states  # noqa: F401  they register their queries

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from phaseloom.plans import assistant, choices, contexts, oracle, scoring, states

    return oracle.SQL | contexts.sql() | states.sql() | assistant.sql() | scoring.sql() | choices.sql()


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to `places` decimals, integers to long: what two engines can be compared on."""
    out = []
    for name, kind in df.dtypes:
        col = F.col(f"`{name}`")
        out.append(F.round(col, places).alias(name) if kind in ("double", "float") else col.cast("long").alias(name) if kind in ("int", "bigint", "smallint", "boolean") else col)
    return df.select(*out)


def frames(spark: SparkSession, sf: str) -> DataFrame:
    return trajectory.frames_from_events(table(spark, sf, "events"))


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, prob, label, phase, video: labelled documents with a score that depends on their length."""
    docs = table(spark, sf, "documents").select("doc_id", ((F.col("n_chars") % 1000) / 1000).alias("prob"))
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("long").alias("label"))
    return docs.join(labels, "doc_id").select("doc_id", "prob", "label", (F.col("doc_id") % 15).alias("phase"), (F.col("doc_id") % 20).alias("video"))


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """video, frame, first, second: two competing scores of a frame."""
    return frames(spark, sf).select("video", "frame", F.round("value", 6).alias("first"), F.round(F.lit(100.0) - F.col("frame"), 6).alias("second"))


#: Sentences that conversations are given one of in turn, so that each category, kind, class and rule has rows.
SAID = (
    "Quelle est la phase actuelle de cette video ?", "Pourquoi le modèle prédit t5 ?", "Qu'est-ce que la calibration ?",
    "Le modèle prédit la phase t4 avec une probabilité de 0,82 à la fenêtre 156.", "L'annotation montre une transition t4 -> t6 après 12 fenêtres; un saut de phase est observé.",
    "La phase t7 dure depuis 34 fenêtres selon le modèle.", "Il est possible que cette division soit un clivage direct.",
    "Selon ESHRE, la séquence est compatible avec l'ordre attendu.", "Un diagnostic clinique n'est pas disponible dans la documentation.",
    "Cette anomalie provoque un retard de 3,5 heures.", "L'embryon montre des blastomères réguliers.", "L'entropie est de 1.25 et l'incertitude de 40%.",
    "TODO: relire la ligne 99", "TODO, mais la mesure de 0.91 reste", "Rien de plus.",
    "La phase t9+ dure 14,5 heures, t9+-2 aussi, t9+.",
)
#: Rules of the compaction query: lines of tasks go, unless they hold a measure.
LINE_RULES, KEEP_RULES = (("task", ("todo", "fixme")), ("boilerplate", ("all rights reserved",))), (("measure", ("mesure", "measure")),)


def dialogue(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations, each turn followed by a line of SAID."""
    place = (F.col("conv_id") * 7 + F.col("turn") * 3) % len(SAID)
    said = F.coalesce(F.get(F.array(*[F.lit(x) for x in SAID]), place.cast("int")), F.lit(""))
    return table(spark, sf, "conversations").withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), said))


def centres(spark: SparkSession, sf: str) -> DataFrame:
    return frames(spark, sf).groupBy("video").agg(F.floor((F.max("frame") + 1) / 2).cast("long").alias("centre"))


# Windows


@query
def windows_labelled(spark, sf):
    windows = trajectory.with_window_start(trajectory.sliding_windows(frames(spark, sf)))
    return windows.select("video", "window_start", "first_frame_phase", "last_frame_phase", "consistency_flag")


@query
def window_flag_counts(spark, sf):
    return trajectory.sliding_windows(frames(spark, sf)).groupBy("consistency_flag").agg(F.count(F.lit(1)).alias("n"))


@query
def phase_transition_matrix(spark, sf):
    return rounded(trajectory.transition_matrix(trajectory.sliding_windows(frames(spark, sf))))


@query
def unfiltered_windows(spark, sf):
    return trajectory.sliding_windows(frames(spark, sf), size=8, stride=4, any_phases=True).groupBy("video").agg(F.count(F.lit(1)).alias("n"), F.sum("consistency_flag").alias("n_changing"))


@query
def window_exact_partner(spark, sf):
    windows = trajectory.sliding_windows(frames(spark, sf)).select("video", F.col("first_frame").alias("window_start"))
    return trajectory.exact_partner(windows, 7).groupBy("video").agg(F.count(F.lit(1)).alias("n"), F.sum("has_partner").alias("n_covered"))


def _ranges(spark, sf):
    runs = trajectory.segments(frames(spark, sf))
    return runs.select("video", "phase", F.col("start").alias("frame_start"), (F.col("end") + 3).alias("frame_end"), F.col("seg_no").alias("range_no"))


@query
def range_join_annotations(spark, sf):
    found = trajectory.explode_annotations(_ranges(spark, sf), frames(spark, sf))
    return found.groupBy("video", "range_phase").agg(F.count(F.lit(1)).alias("n"))


@query
def range_join_last_wins(spark, sf):
    return trajectory.explode_annotations(_ranges(spark, sf), frames(spark, sf), last_wins=True).select("video", "frame", "range_phase")


# Segments and transitions


@query
def segments(spark, sf):
    return trajectory.segments(frames(spark, sf)).select("video", "seg_no", "phase", "start", "end", "duration")


@query
def segment_censoring(spark, sf):
    return trajectory.segments(frames(spark, sf)).groupBy("phase", "censoring").agg(F.count(F.lit(1)).alias("n"))


@query
def segment_sanity(spark, sf):
    return trajectory.segment_sanity(trajectory.segments(frames(spark, sf)))


@query
def duration_stats(spark, sf):
    return rounded(trajectory.duration_stats(trajectory.segments(frames(spark, sf))))


@query
def dmax_strategies(spark, sf):
    return rounded(trajectory.dmax(trajectory.segments(frames(spark, sf))))


@query
def cv_groups(spark, sf):
    return rounded(trajectory.cv_groups(trajectory.duration_stats(trajectory.segments(frames(spark, sf)))))


@query
def transition_events(spark, sf):
    return trajectory.transition_events(trajectory.segments(frames(spark, sf)))


@query
def phase_skips_returns_regressions(spark, sf):
    return rounded(trajectory.skips_returns_regressions(trajectory.transition_events(trajectory.segments(frames(spark, sf)))).na.fill(0, ["is_return"]))


@query
def asof_last_next_transition(spark, sf):
    series = frames(spark, sf)
    return trajectory.asof_transitions(series, trajectory.transition_events(trajectory.segments(series)))


@query
def events_at_frame(spark, sf):
    events = trajectory.transition_events(trajectory.segments(frames(spark, sf)))
    return trajectory.stabbing(events, F.lit(13)).select("video", "from_phase", "to_phase", "window_start", "window_end")


@query
def history_band(spark, sf):
    return rounded(trajectory.history_band(frames(spark, sf), centres(spark, sf), 5, 5)).select("video", "frame", "phase", "offset_from_center", "truncated")


@query
def stability_after_centre(spark, sf):
    return trajectory.stability(frames(spark, sf), centres(spark, sf))


@query
def timeline_segments(spark, sf):
    series = frames(spark, sf).withColumn("score", F.col("value") / 1000)
    return rounded(trajectory.timeline(series), 9)


@query
def change_points(spark, sf):
    return rounded(trajectory.change_points(frames(spark, sf), "phase").groupBy("before", "after").agg(F.count(F.lit(1)).alias("n")))


@query
def model_observed_lag(spark, sf):
    series = frames(spark, sf)
    events = trajectory.transition_events(trajectory.segments(series))
    shifted = events.filter("seg_no % 2 = 0").withColumn("window_end", F.col("window_end") + F.col("seg_no") % 5)
    return trajectory.matched_lag(events, shifted)


@query
def series_gap_extrema(spark, sf):
    return rounded(trajectory.gap_extrema(scores(spark, sf)))


@query
def series_convergence(spark, sf):
    return rounded(trajectory.convergence(scores(spark, sf)))


# State models


@query
def hmm_initial(spark, sf):
    return rounded(hmm.initial_distribution(frames(spark, sf)))


@query
def hmm_transition_matrix(spark, sf):
    series = frames(spark, sf)
    return rounded(hmm.transition_probabilities(series, trajectory.segments(series)))


@query
def semi_hmm_transition_matrix(spark, sf):
    return rounded(hmm.segment_probabilities(trajectory.segments(frames(spark, sf))))


@query
def state_prior(spark, sf):
    return rounded(hmm.state_prior(frames(spark, sf)))


@query
def base_rate(spark, sf):
    return rounded(hmm.base_rate(trajectory.sliding_windows(frames(spark, sf))))


@query
def empirical_durations(spark, sf):
    return rounded(hmm.expected_duration(hmm.empirical_durations(trajectory.segments(frames(spark, sf)), 24)))


def observed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Frames of even videos, with phases, and of odd videos without, but with emissions by a classifier of the former: it sees values and times alone.

    Frames are numbered once and written to the checkpoint folder: the classifier, the state models and the decoding read them some ten times.
    """
    rows = checkpointed(frames(spark, sf).select("video", "frame", "value", "phase")).withColumn("features", F.array(F.col("value") / 100, F.col("frame") / 12, F.sqrt(F.col("frame"))))
    train = rows.filter("video % 2 = 0")
    return train, hmm.with_emissions(rows.filter("video % 2 = 1").drop("phase"), hmm.fit_emissions(train, "features"), "features")


@query
def hmm_forward_posterior(spark, sf):
    """Rows only: a fold over each video, held against numpy in tests. Videos whose phases were not learnt from are filtered."""
    train, asked = observed(spark, sf)
    return rounded(hmm.forward_in_sql(asked, hmm.initial_distribution(train), hmm.transition_probabilities(train, trajectory.segments(train))))


@query
def phase_distributions(spark, sf):
    """Each video's share of frames by phase: leader, runner-up, gap, entropy and what the three likeliest leave out."""
    counts = frames(spark, sf).groupBy("video", "phase").agg(F.count(F.lit(1)).alias("n"))
    share = counts.withColumn("p", F.col("n") / F.sum("n").over(W.partitionBy("video")))
    probs = share.groupBy("video").agg(F.map_from_entries(F.collect_list(F.struct(F.lpad(F.col("phase").cast("string"), 2, "0"), "p"))).alias("m"))
    m = F.col("m")
    return rounded(probs.select("video", D.leader(m).alias("leader"), D.runner_up(m).alias("runner_up"), D.gap(m).alias("gap"), D.entropy(m).alias("entropy"), D.omitted(m, 3)["mass"].alias("omitted_mass"), D.omitted(m, 3)["count"].alias("omitted_count"), F.size(D.top_k(m, 3)).alias("n_top")))


@query
def duration_quantiles(spark, sf):
    table_ = hmm.empirical_durations(trajectory.segments(frames(spark, sf)), 24)
    pmf = table_.groupBy("phase").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "p"))), lambda x: x["p"]).alias("pmf"))
    return rounded(pmf.select("phase", D.quantile(F.col("pmf"), 0.5).alias("q50"), D.quantile(F.col("pmf"), 0.9).alias("q90"), D.first_argmax(F.col("pmf")).alias("mode_at")))


@query
def model_ladder(spark, sf):
    """Rows only: iterative fits. Embeddings as windows, a window changes if the next vector has another label."""
    rows = table(spark, sf, "embeddings").select((F.col("vec_id") % 10).alias("video"), F.col("vec_id").alias("window_start"), "embedding", "label")
    flag = (F.col("label") != F.lead("label").over(W.partitionBy("video").orderBy("window_start"))).cast("int")
    rows = rows.withColumn("consistency_flag", F.coalesce(flag, F.lit(0))).drop("label")
    return rounded(models.ladder(rows.filter("video < 7"), rows.filter("video >= 7")), 4)


# Evaluation


@query
def binary_metrics(spark, sf):
    return rounded(metrics.binary_metrics(predictions(spark, sf)))


@query
def auroc_exact(spark, sf):
    return rounded(metrics.auroc(predictions(spark, sf)))


@query
def auroc_per_video(spark, sf):
    return rounded(metrics.auroc(predictions(spark, sf), ["video"]))


@query
def average_precision(spark, sf):
    return rounded(metrics.average_precision(predictions(spark, sf)))


@query
def log_loss(spark, sf):
    return rounded(metrics.log_loss(predictions(spark, sf)))


@query
def brier_scores(spark, sf):
    return rounded(metrics.brier(predictions(spark, sf)))


@query
def calibration_bins(spark, sf):
    return rounded(metrics.calibration_bins(predictions(spark, sf)))


@query
def ece(spark, sf):
    return rounded(metrics.ece(metrics.calibration_bins(predictions(spark, sf))))


@query
def murphy_decomposition(spark, sf):
    return rounded(metrics.murphy(metrics.calibration_bins(predictions(spark, sf))))


@query
def per_phase_calibration(spark, sf):
    return rounded(metrics.per_phase(predictions(spark, sf)))


def _centroids(spark, sf):
    return vectors.nearest_centroid(table(spark, sf, "embeddings").filter("embedding is not null and label is not null"), "label", "embedding").select("vec_id", "actual", "predicted")


@query
def confusion_top4(spark, sf):
    return rounded(metrics.confusion(_centroids(spark, sf)))


@query
def class_metrics(spark, sf):
    return rounded(metrics.class_metrics(_centroids(spark, sf)))


@query
def balanced_accuracy_macro_f1(spark, sf):
    return rounded(metrics.multiclass_summary(_centroids(spark, sf)))


@query
def class_weights(spark, sf):
    return rounded(metrics.class_weights(frames(spark, sf), "phase", 0.5))


@query
def bootstrap_ci(spark, sf):
    return rounded(metrics.interval(metrics.bootstrap_metric(predictions(spark, sf), "video", 50), "auroc"))


@query
def paired_bootstrap(spark, sf):
    preds = predictions(spark, sf)
    a = metrics.bootstrap_metric(preds, "video", 30).select("resample_id", F.col("accuracy").alias("a"))
    b = metrics.bootstrap_metric(preds.withColumn("prob", F.least(F.lit(1.0), F.col("prob") + 0.2)), "video", 30).select("resample_id", F.col("accuracy").alias("b"))
    return rounded(metrics.paired_difference(a.join(b, "resample_id")).drop("tie_term"))


@query
def holm_bonferroni(spark, sf):
    tests = predictions(spark, sf).groupBy(F.col("video").alias("test")).agg((F.abs(F.avg("prob") - 0.5) / 4).alias("p_value"))
    return rounded(metrics.holm(tests))


@query
def pearson_spearman_partial(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_quantity").alias("x"), F.round(F.col("l_extendedprice") / 1000).alias("y"), F.col("l_discount").alias("z"))
    return rounded(metrics.correlations(rows))


@query
def select_best_config(spark, sf):
    per = predictions(spark, sf)
    grid = metrics.auroc(per, ["phase"]).join(metrics.per_phase(per), "phase").join(metrics.binary_metrics(per, by=["phase"]).select("phase", "accuracy"), "phase")
    return rounded(metrics.select_config(grid.select(F.col("phase").alias("config_no"), "auroc", "brier", "accuracy"), 0.5))


@query
def coverage_restricted(spark, sf):
    """All predictions, and those whose partner, the row one step before in the same video, has a prediction too."""
    rows = predictions(spark, sf)
    partner = rows.select((F.col("doc_id") + 20).alias("doc_id")).distinct().withColumn("covered", F.lit(True))
    rows = rows.join(partner, "doc_id", "left").withColumn("covered", F.coalesce("covered", F.lit(False)))
    both = rows.withColumn("scope", F.explode(F.when(F.col("covered"), F.array(F.lit("all"), F.lit("covered"))).otherwise(F.array(F.lit("all")))))
    return rounded(metrics.binary_metrics(both, by=["scope"]).join(metrics.auroc(both, ["scope"]), "scope"))


def class_scores(spark: SparkSession, sf: str) -> DataFrame:
    """probs over three classes and truth: documents by their length, with scores that depend on length and id."""
    docs = table(spark, sf, "documents").filter("n_chars is not null and doc_id is not null")
    raw = [((F.col("n_chars") * (k + 3) + F.col("doc_id")) % 97 + 1).cast("double") for k in range(3)]
    probs = F.array(*[r / (raw[0] + raw[1] + raw[2]) for r in raw])
    return docs.select(probs.alias("probs"), (F.col("n_chars") % 3).alias("truth"))


@query
def multiclass_auroc(spark, sf):
    return rounded(metrics.one_against_rest(class_scores(spark, sf), 3))


@query
def multiclass_ranking(spark, sf):
    return rounded(metrics.ranking_summary(class_scores(spark, sf), 3))


@query
def window_times(spark, sf):
    timed = frames(spark, sf).join(table(spark, sf, "events").select("event_id", F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").cast("double").alias("time")), "event_id")
    return rounded(trajectory.window_times(timed), 3)


@query
def aligned_truth(spark, sf):
    """Windows with their times and, from another plan, their phases; both must hold the same windows."""
    timed = frames(spark, sf).join(table(spark, sf, "events").select("event_id", F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").cast("double").alias("time")), "event_id")
    windows = trajectory.sliding_windows(frames(spark, sf), any_phases=True).select("video", "first_frame", "first_frame_phase", "last_frame_phase")
    both = trajectory.aligned(trajectory.window_times(timed), windows, ["video", "first_frame"])
    return rounded(both.groupBy("first_frame_phase", "last_frame_phase").agg(F.count(F.lit(1)).alias("n"), F.avg("duration").alias("mean_duration")), 3)


# Sampling


@query
def patient_split(spark, sf):
    return sampling.group_split(frames(spark, sf), "video")


@query
def sampled_groups(spark, sf):
    return sampling.sample_groups(frames(spark, sf), "video", 7).groupBy("video").agg(F.count(F.lit(1)).alias("n"))


@query
def balanced_undersample(spark, sf):
    windows = trajectory.sliding_windows(frames(spark, sf))
    return sampling.undersample(windows, "consistency_flag", "video", "first_frame").select("video", "first_frame", "consistency_flag")


@query
def shuffle_control(spark, sf):
    return sampling.shuffle_within(frames(spark, sf), ["phase"]).select("video", "frame", "phase")


@query
def split_leakage(spark, sf):
    rows = frames(spark, sf).join(sampling.group_split(frames(spark, sf), "video"), "video").withColumn("split", F.when((F.col("video") % 5 == 0) & (F.col("frame") == 1), "leaked").otherwise(F.col("split")))
    return registry.leaks(rows, "video", "split")


# Vectors


@query
def cosine_topk(spark, sf):
    rows = table(spark, sf, "embeddings")
    return rounded(vectors.cosine_topk(rows.filter("vec_id % 20 = 0"), rows, 5))


@query
def knn_agreement(spark, sf):
    rows = table(spark, sf, "embeddings")
    near = vectors.cosine_topk(rows.filter("vec_id % 20 = 0"), rows, 5)
    return rounded(vectors.neighbour_agreement(near, rows.select("vec_id", F.col("label").cast("long").alias("label"))))


@query
def consecutive_distance(spark, sf):
    return rounded(vectors.consecutive_distance(table(spark, sf, "embeddings"), "label", "vec_id", "embedding").select("vec_id", "label", "step"), 5)


@query
def vector_quality_checks(spark, sf):
    return rounded(vectors.quality_checks(table(spark, sf, "embeddings"), "vec_id", "embedding", 64))


@query
def standardised_norms(spark, sf):
    rows = vectors.standardised(table(spark, sf, "embeddings").select("vec_id", "embedding"), "embedding")
    return rounded(rows.select("vec_id", vectors.norm(F.col("embedding")).alias("length")), 5)


@query
def cluster_agreement(spark, sf):
    rows = table(spark, sf, "embeddings").select(F.col("label").cast("long").alias("label"), (F.col("vec_id") % 7).alias("cluster"))
    return rounded(vectors.cluster_agreement(rows))


@query
def kmeans_agreement(spark, sf):
    """Rows only: the clusters depend on the random start."""
    rows = vectors.kmeans(table(spark, sf, "embeddings"), "embedding", 10)
    return rounded(vectors.cluster_agreement(rows.select("label", "cluster")))


@query
def cumulative_variance(spark, sf):
    """Rows only: eigenvalues of a covariance."""
    return rounded(vectors.cumulative_variance(table(spark, sf, "embeddings"), "embedding"))


@query
def linear_dynamics_forecast(spark, sf):
    """Rows only: a ridge regression solved once, held against numpy in tests."""
    rows = table(spark, sf, "embeddings")
    a, b = vectors.linear_dynamics(rows, "label", "vec_id", "embedding")
    return rounded(vectors.forecast_errors(rows, "label", "vec_id", "embedding", a, b, [1, 2, 3]))


@query
def logistic_auroc(spark, sf):
    """Rows only: an iterative fit."""
    rows = predictions(spark, sf).withColumnsRenamed({"prob": "x"})
    return rounded(metrics.auroc(vectors.logistic_scores(rows, ["x"], "label")), 4)


# Corpus


@query
def doc_chunks(spark, sf):
    """Rows only: greedy packing, held against a plain loop in tests."""
    return corpus.chunks(table(spark, sf, "documents"), "doc_id", "text").select("doc_id", "chunk_no", "chunk_id", "heading", F.sha2("content", 256).alias("digest"), "n_chars")


@query
def chunk_hashes(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", corpus.digest(F.col("text")).alias("hash"), corpus.slug(F.concat(F.lit(" Doc-"), F.col("source"), F.lit("_"), F.col("doc_id").cast("string"), F.lit(".md"))).alias("slug"), corpus.chunk_id(F.col("source"), F.col("doc_id") % 100).alias("chunk_id"))


def _manifests(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), F.md5(F.col("text").cast("binary")).alias("hash"))
    old = docs.filter("document_id % 7 <> 0").withColumn("hash", F.when(F.col("document_id") % 5 == 0, "old").otherwise(F.col("hash")))
    return old, docs.filter("document_id % 11 <> 0")


@query
def ingest_plan(spark, sf):
    return corpus.ingest_plan(*_manifests(spark, sf))


@query
def corpus_inventory(spark, sf):
    return corpus.inventory(*_manifests(spark, sf), "document_id").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query
def lexical_topk(spark, sf):
    return rounded(corpus.lexical_topk(table(spark, sf, "benchmark"), table(spark, sf, "documents"), 3, "item_id", "text", "doc_id", "text"))


@query
def retrieval_metrics(spark, sf):
    top = corpus.lexical_topk(table(spark, sf, "benchmark"), table(spark, sf, "documents"), 5, "item_id", "text", "doc_id", "text")
    ranked = top.select("query_id", "rank", (F.col("block_id") % 50).alias("document_id"))
    wanted = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.sequence(F.lit(0), F.lit(24)).cast("array<bigint>")).alias("document_id"))
    return rounded(corpus.retrieval_metrics(ranked, wanted))


@query
def line_rule_compaction(spark, sf):
    found = corpus.compacted(dialogue(spark, sf).groupBy((F.col("conv_id") * 1000 + F.col("turn")).alias("id")).agg(F.min("text").alias("text")), "id", "text", (), LINE_RULES, KEEP_RULES)
    return rounded(found.agg(F.count(F.lit(1)).alias("n"), F.sum("n_lines").alias("n_lines"), F.sum("n_dropped").alias("n_dropped")))


@query
def corpus_lint(spark, sf):
    return rounded(corpus.lint(table(spark, sf, "documents"), "doc_id", "text", ["0", "1", "missing"]))


# Questions and answers


@query
def route_questions(spark, sf):
    return grounding.route(dialogue(spark, sf), "text").groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.sum("n_domain").alias("n_domain"))


@query
def extract_claims(spark, sf):
    """Rows only: Java and RE2 read patterns differently; rules are tested on made sentences."""
    turns = dialogue(spark, sf).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return grounding.claims(turns, "text", "id").groupBy("kind", "is_hedged").agg(F.count(F.lit(1)).alias("n"))


@query
def grounding_numbers(spark, sf):
    turns = dialogue(spark, sf)
    last = F.lag("text").over(W.partitionBy("conv_id").orderBy("turn", "role", "text"))
    rows = grounding.grounding(turns.withColumn("context", last), "text", "context")
    return rounded(rows.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("checked")).alias("n_checked"), F.sum(F.size("ungrounded")).alias("n_ungrounded"), F.sum("is_grounded").alias("n_grounded")))


@query
def framing_provenance(spark, sf):
    rows = dialogue(spark, sf).select(F.explode(grounding.framing(F.col("text"))).alias("framing"))
    return rows.groupBy("framing").agg(F.count(F.lit(1)).alias("n"))


@query
def rule_verdicts(spark, sf):
    """Rows only, as it rests on the extracted claims."""
    turns = dialogue(spark, sf).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    found = grounding.claims(turns, "text", "id").withColumn("has_observed", F.col("id") % 2 == 0).withColumn("has_model", F.lit(True))
    return grounding.report(grounding.verdicts(found), "id")


# Registry, sets and audits


@query
def registry_listing(spark, sf):
    users = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")
    roles = table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("role"), F.lit("x").alias("password"))
    return rounded(registry.listing(users, roles, "c_custkey", "BUILDING"))


@query
def access_filtered(spark, sf):
    return rounded(registry.accessible(table(spark, sf, "customer"), "c_nationkey", 3, False).select("c_custkey", "c_name", "c_nationkey"))


@query
def search_page(spark, sf):
    found = registry.search(table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment"), "build")
    return registry.page(found, [F.desc("c_custkey")], 2, 10)


@query
def natural_order(spark, sf):
    names = table(spark, sf, "nation").select(F.concat(F.col("n_name"), F.lit("_"), F.col("n_nationkey").cast("string")).alias("name"))
    return registry.dense_ids(names, "name")


@query
def change_set(spark, sf):
    rows = table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    ops = rows.filter("s_suppkey % 3 < 2").select("s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, "delete").otherwise("update").alias("op"), F.lit(None).cast("string").alias("s_name"), (F.col("s_acctbal") * 2).alias("s_acctbal"))
    new = rows.limit(1).select(F.lit(10**9).cast("long").alias("s_suppkey"), F.lit("insert").alias("op"), F.lit("new").alias("s_name"), F.lit(1.5).alias("s_acctbal"))
    return rounded(registry.apply_changes(rows, ops.unionByName(new), "s_suppkey"), 2)


@query
def set_audit(spark, sf):
    parts = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("k"))
    return registry.set_audit(parts, table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k")), "k")


@query
def run_summary(spark, sf):
    return rounded(audit.run_summary(table(spark, sf, "conversations"), "role", "text", F.col("turn") % 3 == 0, F.length("text") / 8))


@query
def run_comparability(spark, sf):
    return rounded(audit.comparability(table(spark, sf, "orders"), "o_orderstatus", ["o_orderpriority"]))


@query
def experiment_scores(spark, sf):
    rows = table(spark, sf, "orders").select((F.col("o_custkey") % 50).alias("question"), F.col("o_orderstatus").alias("condition"), F.expr("case o_orderkey % 3 when 0 then 'PASS' when 1 then 'PARTIAL' else 'FAIL' end").alias("grade"))
    return rounded(audit.graded(rows))


@query
def verdict_changes(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_totalprice") > 150000).alias("before"), (F.col("o_totalprice") > 200000).alias("after"))
    return rounded(audit.verdict_changes(rows))
