"""End-to-end plans: training context, ranker training with evaluation, negative mining, answering."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import hooks
from millrace.operators import evaluate, fusion, mining, rank, split, vector
from millrace.plans.candidates import Encoded, candidate_features
from millrace.plans.config import Config, sha256_of
from millrace.plans.context import Stage, held_out_items, make_stage, master_corpus, normalized_log
from millrace.scratch import materialize


@dataclass
class TrainContext:
    """The hold-outs, what is left of the log, the items of each hold-out, and the corpus of all that is encoded."""

    log: DataFrame
    val: split.HeldOut
    ranker: split.HeldOut
    bench: DataFrame
    master: DataFrame
    positives: DataFrame

    @property
    def train_part(self) -> DataFrame:
        return self.ranker.remaining


def _kept(held: split.HeldOut, name: str) -> split.HeldOut:
    """A hold-out as tables, so that the next one does not choose it anew."""
    return split.HeldOut(*(materialize(df, f"{name}-{part}") for part, df in zip(("queries", "qrels", "positives", "remaining"), (held.queries, held.qrels, held.positives, held.remaining), strict=True)))


def build_train_context(log: DataFrame, bench: DataFrame, cfg: Config | None = None) -> TrainContext:
    """Splits the log (with ``row_id``) and gathers the corpus: benchmark items, then both hold-outs' positives."""
    cfg = cfg or Config()
    keyed = normalized_log(log)
    val = _kept(split.hold_out(keyed, cfg.n_validation_queries, cfg.seen_fraction, cfg.seed, "v"), "val")
    ranker = _kept(split.hold_out(val.remaining, cfg.n_ranker_queries, cfg.seen_fraction, cfg.seed + 1, "r", None, val.queries), "ranker")
    master = materialize(master_corpus(bench, held_out_items(keyed, val), held_out_items(keyed, ranker)), "master")
    return TrainContext(keyed, val, ranker, bench, master, val.positives.union(ranker.positives).distinct())


def make_train_stage(context: TrainContext, name: str, lemmatizer: hooks.Lemmatizer | None = None) -> Stage:
    """The stage ``val`` or ``ranker``: the benchmark's items and its own positives, with the train part as history."""
    held = {"val": context.val, "ranker": context.ranker}[name]
    own = held_out_items(context.log, held)
    queries = held.queries.withColumn("search_query", F.col("search_query_norm"))
    return make_stage(name, context.bench, own, held, queries, context.train_part, context.positives, lemmatizer)


def encode_stage(stage: Stage, encoder_factory: Callable[[], hooks.Encoder]) -> Encoded:
    """Encodes the distinct texts of a stage's items and queries."""
    fields = lambda key: [key, F.col("encoded.dense").alias("vec"), F.col("encoded.sparse").alias("weights"), F.col("encoded.tokens").alias("tokens")]
    items = hooks.encode(stage.items.select("item_id", "item_tower_text"), "item_tower_text", encoder_factory).select(*fields("item_id"))
    queries = hooks.encode(stage.queries.select("query_id", "query_tower_text"), "query_tower_text", encoder_factory).select(*fields("query_id"))
    return Encoded(materialize(items, "encoded-items"), materialize(queries, "encoded-queries"))


def train_on_stage(stage: Stage, encoded: Encoded | None, cfg: Config | None = None, **options) -> PipelineModel:
    """Fits the default ranker on a stage's labelled pool."""
    frame = evaluate.label_candidates(candidate_features(stage, encoded, cfg), stage.qrels)
    return rank.train_ranker(frame.withColumn("label", F.col("label").cast("double")), **options)


def rank_stage(model: PipelineModel, stage: Stage, encoded: Encoded | None, cfg: Config | None = None) -> DataFrame:
    """``query_id, item_id, score, rank`` of every pair of a stage's pool."""
    scored = rank.predict_scores(model, candidate_features(stage, encoded, cfg)).select("query_id", "item_id", "score")
    return materialize(fusion.rank_by(scored, [F.col("score").desc(), F.col("item_id")]), "ranked")


def report(ranked: DataFrame, stage: Stage, k: int = 50) -> DataFrame:
    """``metric, value``: recall at ``k``, of each stratum, and of the whole pool."""
    per = evaluate.per_query_recall(ranked, stage.qrels, k)
    overall = evaluate.recall_at_k(ranked, stage.qrels, k).select(F.lit(f"recall@{k}").alias("metric"), F.col("recall").alias("value"))
    ceiling = evaluate.recall_at_k(ranked, stage.qrels, None).select(F.lit("pool ceiling").alias("metric"), F.col("recall").alias("value"))
    strata = stage.queries.sparkSession.createDataFrame([], "query_id string, stratum string") if "stratum" not in stage.queries.columns else stage.queries
    by = evaluate.stratified_recall(per, strata).select(F.concat(F.lit(f"recall@{k} "), "stratum").alias("metric"), F.col("recall").alias("value"))
    return overall.unionByName(ceiling).unionByName(by)


def answer_lists(ranked: DataFrame, stage: Stage, k: int = 50) -> DataFrame:
    """``query_id, answer`` for every query of the stage."""
    from millrace.sources.answer import answer_rows

    return answer_rows(stage.queries, ranked, k)


def mine(log: DataFrame, cfg: Config | None = None, encoder_factory: Callable[[], hooks.Encoder] | None = None, lemmatizer: hooks.Lemmatizer | None = None, seed: int | None = None) -> DataFrame:
    """``search_query_norm, item_id, negative_id, stratum``: hard negatives for the pairs of a cleaned log.

    The ranking of each distinct text is the lexical one, fused with the dense one where there is an encoder.
    """
    cfg = cfg or Config()
    items, positives = mining.mining_corpus(log)
    fields = items.withColumns({"title": hooks.lemmas("item_title_raw", lemmatizer), "params": hooks.lemmas("item_infm_params_text", lemmatizer), "desc": hooks.lemmas("item_description_raw", lemmatizer)})
    texts = log.select(F.col("search_query_norm").alias("query_id")).distinct()
    ranking = mining.lexical_rankings(texts.withColumn("tokens", hooks.lemmas("query_id", lemmatizer)), fields, cfg.negative_rank_max, cfg.field_weights)
    if encoder_factory is not None:
        place = F.lit(None).cast("int").alias("location")
        d = hooks.encode(items.select("item_id", "item_tower_text"), "item_tower_text", encoder_factory).select("item_id", F.col("encoded.dense").alias("vec"), place)
        q = hooks.encode(texts.withColumn("t", F.col("query_id")), "t", encoder_factory).select("query_id", F.col("encoded.dense").alias("vec"), place)
        ranking = mining.fused_ranking(vector.dense_tour(q, d, cfg.negative_rank_max), ranking, cfg.rrf_k)
    ranked = materialize(ranking.select(F.col("query_id").alias("search_query_norm"), "item_id", "rank"), "ranking")
    return mining.mine_negatives(positives, ranked, items, positives, cfg.hard_negatives_per_positive, cfg.negative_rank_min, cfg.negative_rank_max, cfg.seed if seed is None else seed)


def file_has_digest(path: str, sha256: str) -> bool:
    """Whether a local model file is whole; models are never fetched."""
    return sha256_of(path) == sha256.lower()
