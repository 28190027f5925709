"""Raw tasks to clean corpus, topics to taxonomy, taxonomy to training set: the end-to-end plans."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tasksieve import constants as K
from tasksieve.functions.conditions import build_text, coalesce_empty
from tasksieve.functions.text import clean_notes, extract_field, lowercase, mask_structural
from tasksieve.operators.audit import traceability_check
from tasksieve.operators.cluster import best_topic, split_test
from tasksieve.operators.dedup import dedup_keep_first
from tasksieve.operators.entities import SPAN, anonymization_log, assign_platform, extract_entities, remove_entities
from tasksieve.operators.features import class_tfidf, joined_terms
from tasksieve.operators.filters import filter_chain, min_length_filter, task_rules
from tasksieve.operators.masking import derive_mask_rules, detect_pii, detection_log, mask_dictionary
from tasksieve.operators.taxonomy import apply_name_map, apply_overrides, apply_topic_merges, knn_redistribute, override_pillars, rename_labels
from tasksieve.operators.topics import (classify_passport, dominant_platform, final_taxonomy, membership_confidence, merge_partners,
                                        scorecard, suggest_name, taxonomy_draft, topic_centroid, topic_coherence, topic_distribution,
                                        topic_similarity_pairs, total_rows)
from tasksieve.session import checkpointed, small_side

ROW = "__row"
#: Ids that are sent to the texts, if their bytes allow it.
ID_ROWS = 2_000_000


@dataclass
class CorpusConfig:
    """What differs between deployments."""

    entities: list[tuple[str, str]] = field(default_factory=list)
    tracked: list[str] = field(default_factory=list)
    guarded: tuple[str, ...] = ()
    bot_marker: str = "helperbot"
    session_marker: str = "working session"
    deep_link_host: str | None = None
    example_names: tuple[str, ...] = ()
    household_skip: list[str] | None = None
    min_score: float = 0.85
    min_length: int = 15
    markup: bool = True


def with_text(tasks: DataFrame, config: CorpusConfig, name: str = "name", notes: str = "notes") -> DataFrame:
    """Form fields, cleaned notes, and the text built from them."""
    n = F.col(notes)
    intent = coalesce_empty(extract_field(n, K.INTENT_LABELS[0]), extract_field(n, K.INTENT_LABELS[1]))
    cleaned = clean_notes(n, deep_link_host=config.deep_link_host, example_names=config.example_names, markup=config.markup)
    fields = tasks.withColumns({"form_intent": intent, "form_detail": extract_field(n, K.DETAIL_LABEL), "notes_clean": cleaned})
    return fields.withColumn("original_text", build_text([F.col("form_intent"), F.col(name), F.col("notes_clean")]))


def clean_tasks(tasks: DataFrame, config: CorpusConfig, id_col: str = "task_id") -> DataFrame:
    """Every kept task with its masked and cleaned text, entities and detections.

    Rules come from the distinct metadata (one small job); the rest is a narrow
    projection over the texts.  It is written once to the shared folder, as the
    corpus and both logs are made from it, and as a filter on a cleaned text would
    otherwise be pushed below the cleaning and repeat it.  The stored rows are numbered in ``ROW``.
    """
    kept = filter_chain(tasks, task_rules(config.bot_marker, config.session_marker))
    texts = with_text(kept, config)
    rules = derive_mask_rules(kept, skip=config.household_skip)
    structural = texts.withColumn("masked_text", mask_structural(F.col("original_text"), deep_link_host=config.deep_link_host))
    masked = mask_dictionary(structural, "masked_text", rules, id_col=id_col)
    scanned = detect_pii(masked, "masked_text", min_score=config.min_score)
    spans = (extract_entities(F.col("masked_text"), config.entities, config.guarded) if config.entities
             else F.array().cast(SPAN))
    marked = scanned.withColumn("entities", spans)
    platforms = assign_platform(F.col("entities"), config.tracked) if config.tracked else F.struct(
        F.lit("General").alias("primary_platform"), F.lit(None).cast("string").alias("secondary_platform"))
    cleaned = marked.withColumns({
        "cleaned_text": lowercase(remove_entities(F.col("masked_text"), F.col("entities"))), "__p": platforms})
    return checkpointed(cleaned.select(*[c for c in cleaned.columns if c not in ("__p", "notes_clean")], "__p.*",
                                       F.monotonically_increasing_id().alias(ROW)))


def clean_corpus(tasks: DataFrame, config: CorpusConfig, key: Column, id_col: str = "task_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(corpus, removal log, detection log)`` of a task table; one shuffle, for de-duplication."""
    cleaned = clean_tasks(tasks, config, id_col)
    corpus = dedup_keep_first(min_length_filter(cleaned.drop("masked_text", "detections"), "cleaned_text", config.min_length),
                              "cleaned_text", key, row=ROW)
    return corpus, anonymization_log(cleaned, "masked_text", "entities", id_col), detection_log(cleaned, id_col=id_col)


def corpus_check(tasks: DataFrame, corpus: DataFrame, log: DataFrame) -> DataFrame:
    return traceability_check(tasks, corpus, log)


def discover(corpus: DataFrame, vec: DataFrame, assign: DataFrame, name_rules: list[tuple], passport_rules: list[tuple],
             suffix_names: Sequence[str] = (), platform: str = "primary_platform", text: str = "cleaned_text",
             stop=(), min_sim: float = 0.75) -> dict[str, DataFrame]:
    """Assignments and vectors to draft, final taxonomy and scorecard; the rules that name topics are the caller's.

    Assignments are kept once; every analysis is an aggregation over them.  So are the texts of assigned rows, dealt by id:
    they may lie in few files of the corpus, and both term tables cut them.
    """
    assign = checkpointed(assign)
    ids = small_side(assign.select("task_id"), ID_ROWS)
    corpus = checkpointed(corpus.select("task_id", text, platform).join(ids, "task_id", "left_semi").repartition("task_id"))
    named = corpus.join(assign.filter(F.col("topic_id") != -1), "task_id")
    cent = topic_centroid(assign.filter(F.col("topic_id") != -1), vec).persist()
    member = best_topic(vec, cent)
    terms = class_tfidf(named, text, stop=stop).persist()
    words = terms.groupBy("topic_id").agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("t")).select(
        "topic_id", F.transform("t", lambda x: x["term"]).alias("words"))
    dist = topic_distribution(assign)
    pairs = topic_similarity_pairs(cent, min_sim).persist()
    draft = checkpointed(taxonomy_draft(
        dist, joined_terms(terms), suggest_name(words, name_rules, dominant_platform(named, platform), suffix_names), topic_coherence(assign, vec),
        membership_confidence(assign, member), split_test(assign, vec, corpus, text, stop=stop), merge_partners(pairs)))
    final = final_taxonomy(draft, classify_passport(draft, passport_rules))
    return {"draft": draft, "final": final, "pairs": pairs, "scorecard": scorecard(final, pairs, total_rows(assign))}


def training_set(corpus: DataFrame, assign: DataFrame, vec: DataFrame, merges: dict, names: dict, dissolve: str | None = None,
                 overrides: dict | None = None, renames: dict | None = None, pillars: dict | None = None) -> DataFrame:
    """Topics to ``(task_id, cleaned_text, label, business_pillar, primary_platform)``."""
    joined = corpus.join(assign.select("task_id", "topic_id"), "task_id", "left")
    out = apply_name_map(apply_topic_merges(joined, merges), names)
    if dissolve:
        lookup = out.groupBy("label").agg(F.min("business_pillar").alias("business_pillar"))
        moved = knn_redistribute(vec, out.select("task_id", "label"), dissolve)
        out = apply_overrides(out, moved, overrides or {}, lookup)
    if renames:
        out = rename_labels(out, renames)
    if pillars:
        out = override_pillars(out, pillars)
    return out.select("task_id", "cleaned_text", "label", "business_pillar", "primary_platform")
