"""Topic analytics: sizes, confidence, centres, similarity, coherence, drafts and reports."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tasksieve import constants as K
from tasksieve.functions.conditions import confidence_band, contains_ci, first_match
from tasksieve.functions.text import truncate_text
from tasksieve.functions.vectors import dot, mean_of, norm2, unit, vector_sum
from tasksieve.operators.features import joined_terms, pad_terms
from tasksieve.operators.neighbours import components, similar_pairs
from tasksieve.session import small_side, top_per_group


def total_rows(df: DataFrame) -> Column:
    """The number of rows as a scalar subquery."""
    return df.agg(F.count("*").alias("n")).scalar()


def share(n: Column, total: Column) -> Column:
    return F.when(total > 0, n * 100 / total).otherwise(0.0)


# ------------------------------------------------------------------ sizes


def group_share(df: DataFrame, keys: list[str]) -> DataFrame:
    """``(*keys, n, pct)``: rows per group and their share of all rows."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return counts.withColumn("pct", share(F.col("n"), total_rows(df)))


def topic_distribution(assign: DataFrame, labels: DataFrame | None = None, topic: str = "topic_id") -> DataFrame:
    """Rows and share per topic (share of all rows, outliers counted), largest first."""
    out = group_share(assign, [topic]).filter(F.col(topic) != -1)
    if labels is not None:
        out = out.join(labels, topic, "left")
    return out.orderBy(F.desc("n"), topic)


def topic_rank(dist: DataFrame, topic: str = "topic_id") -> DataFrame:
    """Rank by size, the outlier topic last.  ``dist`` has one row per topic."""
    order = Window.orderBy(F.col(topic) == -1, F.desc("n"), topic)
    return dist.withColumn("rank", F.row_number().over(order).cast("bigint"))


def top3_share(dist: DataFrame, topic: str = "topic_id", name: str | None = None) -> DataFrame:
    """Names and combined share of the three largest topics (each share to one place)."""
    first = (dist.filter(F.col(topic) != -1).orderBy(F.desc("n"), topic).limit(3)
             .withColumn("__o", F.struct((-F.col("n")).alias("m"), topic)))
    names = F.array_sort(F.collect_list(F.struct("__o", F.col(name or topic).cast("string").alias("name"))))
    return first.agg(F.array_join(F.transform(names, lambda x: x["name"]), ", ").alias("topics"),
                     F.round(F.sum(F.round("pct", 1)), 1).alias("combined_pct"))


def label_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows, share, and whether the label is the smallest one."""
    out = group_share(df, [label])
    smallest = df.groupBy(label).agg(F.count("*").alias("n")).agg(F.min("n").alias("m")).scalar()
    return out.withColumn("is_min", F.col("n") == smallest).orderBy(F.desc("n"), label)


class_sizes = label_distribution


def sub_type_listing(df: DataFrame, pillar: str, label: str) -> DataFrame:
    """Per pillar its labels with counts, as one sorted string."""
    counts = df.groupBy(pillar, label).agg(F.count("*").alias("n"))
    entries = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col(label).alias("l"))))
    return counts.groupBy(pillar).agg(
        F.sum("n").alias("n"),
        F.array_join(F.transform(entries, lambda e: F.concat(e["l"], F.lit(" ("), (-e["m"]).cast("string"), F.lit(")"))), ", ")
        .alias("labels"))


# ------------------------------------------------------------- confidence


def membership_confidence(assign: DataFrame, member: DataFrame, low: float = 0.3, high: float = 0.5,
                          id_col: str = "task_id", topic: str = "topic_id") -> DataFrame:
    """Mean of each row's best probability per assigned topic, with two flags.

    ``member`` is the table of ``soft_membership`` or, without its shuffle, that of ``best_topic``.
    """
    best = (member.select(id_col, F.col("best_prob").alias("best")) if "best_prob" in member.columns
            else member.groupBy(id_col).agg(F.max("prob").alias("best")))
    mean = (assign.filter(F.col(topic) != -1).join(best, id_col).groupBy(topic)
            .agg(F.avg("best").alias("avg_probability")))
    value = F.col("avg_probability")
    return mean.select(topic, "avg_probability", F.when(value < low, "LOW CONFIDENCE").otherwise("OK").alias("flag"),
                       confidence_band(value, low, high).alias("confidence"))


def confidence_distribution(draft: DataFrame) -> DataFrame:
    out = draft.groupBy("confidence").agg(F.count("*").alias("topics"))
    return out.withColumn("pct", share(F.col("topics"), total_rows(draft)))


# -------------------------------------------------- centres and similarity


def topic_centroid(assign: DataFrame, vec: DataFrame | None, id_col: str = "task_id", topic: str = "topic_id",
                   vector: str = "embedding") -> DataFrame:
    """``(topic, n, centroid)``: mean vector per label; ``vec=None`` when vectors are already there."""
    rows = assign if vec is None else assign.select(id_col, topic).join(vec.select(id_col, vector), id_col)
    return vector_sum(rows, [topic], vector).select(topic, "n", mean_of(F.col("total"), F.col("n")).alias("centroid"))


def with_centroid_similarity(assign: DataFrame, vec: DataFrame, id_col: str = "task_id", topic: str = "topic_id",
                             vector: str = "embedding") -> DataFrame:
    """``(id, topic, sim)``: cosine of each row to the centroid of its own topic."""
    rows = assign.filter(F.col(topic) != -1).select(id_col, topic).join(vec.select(id_col, vector), id_col)
    centroids = topic_centroid(rows, None, topic=topic, vector=vector).select(topic, unit("centroid").alias("centroid"))
    return rows.join(small_side(centroids), topic).select(id_col, topic, dot(unit(vector), F.col("centroid")).alias("sim"))


def _unit_centroids(cent: DataFrame, topic: str) -> DataFrame:
    return cent.select(topic, unit("centroid").alias("centroid"))


def similarity_matrix(cent: DataFrame, topic: str = "topic_id") -> DataFrame:
    """``(a, b, sim)`` for all topics, itself included."""
    units = _unit_centroids(cent, topic)
    return similar_pairs(units, units, None, topic, "centroid")


def topic_similarity_pairs(cent: DataFrame, min_sim: float = 0.75, merge: float = 0.85,
                           keywords: DataFrame | None = None, topic: str = "topic_id") -> DataFrame:
    """``(topic_a, topic_b, similarity, recommendation)`` above the threshold, most similar first."""
    units = _unit_centroids(cent, topic)
    pairs = similar_pairs(units, units, min_sim, topic, "centroid", later=True)
    out = pairs.select(F.col("a").alias("topic_a"), F.col("b").alias("topic_b"), F.col("sim").alias("similarity"),
                       F.when(F.col("sim") > merge, "MERGE").otherwise("CONSIDER").alias("recommendation"))
    if keywords is not None:
        for side in ("a", "b"):
            out = out.join(keywords.select(F.col(topic).alias(f"topic_{side}"), F.col("keywords").alias(f"keywords_{side}")),
                           f"topic_{side}", "left")
    return out.orderBy(F.desc("similarity"), "topic_a", "topic_b")


def merge_partners(pairs: DataFrame, topic: str = "topic_id") -> DataFrame:
    """``(topic, merge_with)``: partner ids of each topic, most similar first, joined by a bar."""
    both = pairs.select(F.col("topic_a").alias(topic), F.col("topic_b").alias("partner"), "similarity").unionByName(
        pairs.select(F.col("topic_b").alias(topic), F.col("topic_a").alias("partner"), "similarity"))
    order = F.struct((-F.round("similarity", 9)).alias("m"), "partner")
    return both.groupBy(topic).agg(F.array_sort(F.collect_list(order)).alias("p")).select(
        topic, F.array_join(F.transform("p", lambda x: x["partner"].cast("string")), "|").alias("merge_with"))


def merge_candidates_by_distance(cent: DataFrame, words: DataFrame, max_dist: float = 0.2, label: str = "label") -> DataFrame:
    """Pairs of labels closer than ``max_dist`` with their top words and their overlap, nearest first."""
    lists = words.groupBy(label).agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("t")).select(
        label, F.transform("t", lambda x: x["term"]).alias("words"))
    units = _unit_centroids(cent, label)
    pairs = similar_pairs(units, units, 1 - max_dist, label, "centroid", later=True)
    for side in ("a", "b"):
        pairs = pairs.join(lists.select(F.col(label).alias(side), F.col("words").alias(f"w_{side}")), side, "left")
    empty = F.array().cast("array<string>")
    a, b = F.coalesce("w_a", empty), F.coalesce("w_b", empty)
    common = F.array_intersect(a, b)
    return pairs.select(
        F.col("a").alias("class_a"), F.col("b").alias("class_b"), (1 - F.col("sim")).alias("cosine_distance"),
        F.col("sim").alias("cosine_similarity"), F.array_join(F.slice(a, 1, 8), ", ").alias("words_a"),
        F.array_join(F.slice(b, 1, 8), ", ").alias("words_b"),
        F.array_join(F.slice(F.array_sort(common), 1, 6), ", ").alias("word_overlap"),
        (F.size(common) * 100 / F.greatest(F.size(F.array_union(a, b)), F.lit(1))).alias("overlap_pct"),
    ).orderBy("cosine_distance", "class_a", "class_b")


def merge_components(pairs: DataFrame, labels: DataFrame, a: str, b: str, label: str = "label") -> DataFrame:
    """``(label, component)``: labels linked, directly or not, by the given pairs."""
    alone = labels.select(F.col(label).alias("a"), F.col(label).alias("b"))
    linked = components(pairs.select(F.col(a).alias("a"), F.col(b).alias("b")).unionByName(alone))
    return linked.select(F.col("id").alias(label), "component")


def topic_coherence(assign: DataFrame, vec: DataFrame, id_col: str = "task_id", topic: str = "topic_id",
                    vector: str = "embedding") -> DataFrame:
    """``(topic, n, coherence)``: exact mean cosine over all pairs of a topic.

    Over unit vectors that mean is ``(|S|^2 - n) / (n (n - 1))`` with ``S`` their sum,
    so no pair is formed and nothing is sampled.  A single row scores 0.
    """
    rows = (assign.filter(F.col(topic) != -1).select(id_col, topic)
            .join(vec.select(id_col, unit(vector).alias("u")), id_col))
    n = F.col("n")
    exact = (norm2(F.col("total")) - n) / (n * (n - 1))
    return vector_sum(rows, [topic], "u").select(
        topic, n.cast("bigint").alias("n"), F.when(n > 1, exact).otherwise(0.0).alias("coherence"))


def misfit_docs(assign: DataFrame, vec: DataFrame, docs: DataFrame | None = None, pct: int = 5, cap: int = 5,
                min_docs: int = 10, id_col: str = "task_id", topic: str = "topic_id", text: str = "cleaned_text") -> DataFrame:
    """The rows least like their topic: ``max(1, min(cap, floor(pct % of size)))`` of each topic of ``min_docs`` or more."""
    sims = with_centroid_similarity(assign, vec, id_col, topic)
    last = top_per_group(sims, [topic], [F.asc(F.round("sim", 9)), F.asc(id_col)], cap)
    sizes = assign.filter(F.col(topic) != -1).groupBy(topic).agg(F.count("*").alias("size"))
    wanted = F.greatest(F.lit(1), F.least(F.lit(cap), F.floor(F.col("size") * pct / 100)))
    out = (last.join(sizes, topic).filter((F.col("size") >= min_docs) & (F.col("rank") <= wanted))
           .select(topic, "rank", id_col, "sim"))
    if docs is not None:
        out = out.join(docs.select(id_col, truncate_text(F.col(text), 120).alias("text")), id_col).select(
            topic, "rank", id_col, "sim", "text")
    return out


# ---------------------------------------------------------------- samples


def topic_samples(df: DataFrame, topic: str, key: list[Column], n: int = 50, text: str = "cleaned_text",
                  chars: int = 200, id_col: str = "task_id") -> DataFrame:
    """The first ``n`` rows of each topic (a report of samples), texts cut."""
    first = top_per_group(df.select(topic, id_col, F.col(text).alias("text")).filter(F.col(topic) != -1), [topic], key, n)
    return first.select(topic, "rank", id_col, truncate_text(F.col("text"), chars).alias("text"))


def random_sample_per_group(df: DataFrame, group: list[str], n: int, seed: int = 42, id_col: str = "task_id") -> DataFrame:
    """A seeded sample of ``n`` rows per group, the same on every run."""
    draw = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}")))
    return top_per_group(df.withColumn("__draw", draw), group, [F.asc("__draw"), F.asc(id_col)], n).drop("__draw")


def summary_pack(df: DataFrame, label: str, key: list[Column], pillar: str | None = None, text: str = "cleaned_text",
                 n: int = 40, chars: int = 300) -> DataFrame:
    """Per label: size, pillar, and its first texts as a numbered list."""
    kept = df.select(label, *([pillar] if pillar else []), F.col(text).alias("text"), *[
        c.alias(f"__k{i}") for i, c in enumerate(key)])
    first = top_per_group(kept, [label], [F.asc(f"__k{i}") for i in range(len(key))], n)
    line = F.concat(F.col("rank").cast("string"), F.lit(". "), truncate_text(F.col("text"), chars, "..."))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n")
    packs = first.groupBy(label).agg(body.alias("body"), F.count("*").alias("shown"))
    facts = [F.count("*").alias("n")] + ([F.min(pillar).alias(pillar)] if pillar else [])
    return df.groupBy(label).agg(*facts).join(packs, label)


# ------------------------------------------------------- platforms, crosstabs


def platform_distribution(df: DataFrame, platform: str, topic: str | None = None) -> DataFrame:
    """Rows per platform with share, overall or inside each topic."""
    if topic is None:
        return group_share(df, [platform])
    counts = df.groupBy(topic, platform).agg(F.count("*").alias("n"))
    within = F.sum("n").over(Window.partitionBy(topic))  # over one row per topic and platform
    return counts.withColumn("pct", F.col("n") / within * 100)


def dominant_platform(df: DataFrame, platform: str, topic: str = "topic_id") -> DataFrame:
    """``(topic, dominant, dominant_share)``; ties go to the first name."""
    counts = df.groupBy(topic, platform).agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("m"), F.col(platform).alias("p"))).alias("b")
    return counts.groupBy(topic).agg(best, F.sum("n").alias("total")).select(
        topic, F.col("b.p").alias("dominant"), (-F.col("b.m") / F.col("total")).alias("dominant_share"))


def crosstab_topic_platform(df: DataFrame, topic: str, platform: str, values: list[str] | None = None) -> DataFrame:
    """Contingency table, zero filled, one column per platform."""
    pivoted = df.groupBy(topic).pivot(platform, values).count() if values else df.groupBy(topic).pivot(platform).count()
    return pivoted.na.fill(0)


def crosstab_top_labels(df: DataFrame, tag: str, topic: str, k: int = 5) -> DataFrame:
    """``(topic, rank, tag, n, pct)``: the most frequent tags of each topic; share of its tagged rows."""
    counts = df.filter(F.col(tag) != "").groupBy(topic, tag).agg(F.count("*").alias("n"))
    shared = counts.withColumn("pct", F.col("n") / F.sum("n").over(Window.partitionBy(topic)) * 100)
    return top_per_group(shared, [topic], [F.desc("n"), F.asc(tag)], k).select(topic, "rank", tag, "n", "pct")


def topics_of_top_tags(df: DataFrame, tag: str, topic: str, tags: int = 15, k: int = 3) -> DataFrame:
    """``(tag, rank, topic, n, pct)``: where the rows of the biggest tags went."""
    tagged = df.filter(F.col(tag) != "")
    biggest = tagged.groupBy(tag).agg(F.count("*").alias("tag_n")).orderBy(F.desc("tag_n"), tag).limit(tags)
    counts = tagged.groupBy(tag, topic).agg(F.count("*").alias("n")).join(F.broadcast(biggest), tag)
    shared = counts.withColumn("pct", F.col("n") / F.col("tag_n") * 100)
    return top_per_group(shared, [tag], [F.desc("n"), F.asc(topic)], k).select(tag, "rank", topic, "n", "pct")


def tag_topic_counts(df: DataFrame, tag: str, topic: str, tags: int = 10) -> DataFrame:
    """Rows per tag and topic for the biggest tags."""
    tagged = df.filter(F.col(tag) != "")
    biggest = tagged.groupBy(tag).agg(F.count("*").alias("c")).orderBy(F.desc("c"), tag).limit(tags).select(tag)
    return tagged.groupBy(tag, topic).agg(F.count("*").alias("n")).join(F.broadcast(biggest), tag, "left_semi")


# ------------------------------------------------------------ drafts, rules


def prune_proposal(dist: DataFrame, confidence: DataFrame, pairs: DataFrame, min_docs: int = 15,
                   topic: str = "topic_id") -> DataFrame:
    """``(kind, topic, other, n, reason)``: noise topics (unsure, else small) and pairs to merge."""
    facts = dist.select(topic, "n").join(confidence.select(topic, "avg_probability", "flag"), topic, "left")
    unsure = F.coalesce(F.col("flag") == "LOW CONFIDENCE", F.lit(False))
    reason = F.when(unsure, F.format_string("Low confidence (avg_prob=%.3f)", F.col("avg_probability"))).when(
        F.col("n") < min_docs, F.format_string("Very small cluster (%d docs)", F.col("n")))
    noise = facts.withColumn("reason", reason).filter("reason is not null").select(
        F.lit("NOISE").alias("kind"), F.col(topic).cast("bigint").alias("topic"), F.lit(None).cast("bigint").alias("other"),
        "n", "reason")
    merges = pairs.select(
        F.lit("MERGE").alias("kind"), F.col("topic_a").cast("bigint").alias("topic"), F.col("topic_b").cast("bigint").alias("other"),
        F.lit(None).cast("bigint").alias("n"), F.format_string("Similarity %.4f", F.col("similarity")).alias("reason"))
    return noise.unionByName(merges)


def prune_totals(dist: DataFrame, proposal: DataFrame, total: Column, topic: str = "topic_id") -> DataFrame:
    noise = proposal.filter("kind = 'NOISE'")
    return proposal.agg(
        F.count_if(F.col("kind") == "NOISE").alias("noise_topics"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("noise_docs"),
        F.count_if(F.col("kind") == "MERGE").alias("merge_pairs"),
    ).withColumns({"noise_pct": share(F.col("noise_docs"), total),
                   "kept_topics": total_rows(dist.filter(F.col(topic) != -1)) - F.col("noise_topics")})


def suggest_name(keywords: DataFrame, rules: list[tuple], platforms: DataFrame | None = None, suffix_names: Sequence[str] = (),
                 topic: str = "topic_id", words: int = 6, min_share: float = 0.6) -> DataFrame:
    """``(topic, suggested_name)`` from ``keywords (topic, words array)``; the first rule that holds names it.

    A rule is ``(name, pillar, alternatives)``; an alternative is a list of conditions that must all hold: ``=w``, the
    keyword w is there, ``~p``, the phrase p is in the keywords joined by spaces.  Names in ``suffix_names`` get the
    topic's dominant platform, if it has more than ``min_share`` of the rows.
    """
    kw = F.transform(F.slice(F.col("words"), 1, words), F.lower)
    other = F.concat(F.lit("Topic_"), F.col(topic).cast("string"))
    name = F.coalesce(first_match(rules, kw, 0), other) if rules else other
    if platforms is None:
        return keywords.select(topic, name.alias("suggested_name"))
    suffixed = name.isin(list(suffix_names))
    strong = (F.col("dominant_share") > min_share) & (F.col("dominant") != "General")
    joined = keywords.join(platforms, topic, "left").withColumn("__name", name)
    return joined.select(topic, F.when(F.coalesce(suffixed & strong, F.lit(False)),
                                       F.concat("__name", F.lit(" ("), "dominant", F.lit(")")))
                         .otherwise(F.col("__name")).alias("suggested_name"))


def classify_passport(draft: DataFrame, rules: list[tuple], topic: str = "topic_id", words: int = 8,
                      misfits: DataFrame | None = None) -> DataFrame:
    """``(topic, business_name, business_pillar, label_valid, notes)`` from a taxonomy draft; rules as in ``suggest_name``."""
    kw = F.transform(F.slice(F.split("current_label", ", "), 1, words), F.lower)
    name, pillar = (first_match(rules, kw, i) if rules else F.lit(None).cast("string") for i in (0, 1))
    partners = F.filter(F.split("merge_with", r"\|"), lambda x: x != "")
    if misfits is not None:
        draft = draft.join(misfits.groupBy(topic).agg(F.count("*").alias("__misfits")), topic, "left")
    else:
        draft = draft.withColumn("__misfits", F.lit(0))
    low = F.col("confidence") == "LOW"
    notes = F.array_compact(F.array(
        F.when(low, K.NOTE_LOW_CONFIDENCE), F.when(F.col("coherence") < 0.25, K.NOTE_LOW_COHERENCE),
        F.when(F.col("split_recommended"), F.format_string(K.NOTE_SPLIT, F.col("split_silhouette"))),
        F.when(F.size(partners) > 0, F.concat(F.lit(K.NOTE_MERGE), F.array_join(F.slice(partners, 1, 3), ", "))),
        F.when(F.col("__misfits") > 0, F.concat(F.col("__misfits").cast("string"), F.lit(K.NOTE_MISFITS)))))
    return draft.select(
        topic, F.coalesce(name, F.format_string("Unclassified (Topic %d)", F.col(topic))).alias("business_name"),
        F.coalesce(pillar, F.lit("Uncategorized")).alias("business_pillar"), (~low).alias("label_valid"),
        F.when(F.size(notes) > 0, F.array_join(notes, "; ")).otherwise(K.NOTE_NONE).alias("notes"))


def taxonomy_draft(dist: DataFrame, keywords: DataFrame, names: DataFrame, coherence: DataFrame, confidence: DataFrame,
                   splits: DataFrame, partners: DataFrame, topic: str = "topic_id") -> DataFrame:
    """One row per topic from the separate analyses (all of them tables of topics)."""
    joined = (dist.select(topic, F.col("n").alias("doc_count"), "pct").join(keywords.select(topic, "keywords"), topic, "left")
              .join(names, topic, "left").join(coherence.select(topic, "coherence"), topic, "left")
              .join(confidence.select(topic, "avg_probability", "confidence"), topic, "left")
              .join(splits.select(topic, "split_recommended", "silhouette"), topic, "left").join(partners, topic, "left"))
    return joined.select(
        topic, F.substring(F.coalesce("keywords", F.lit("")), 1, 50).alias("current_label"), "suggested_name", "doc_count",
        F.round("pct", 1).alias("pct"), F.round("coherence", 3).alias("coherence"), "confidence",
        F.round("avg_probability", 4).alias("avg_probability"),
        F.coalesce("split_recommended", F.lit(False)).alias("split_recommended"),
        F.round(F.coalesce("silhouette", F.lit(0.0)), 3).alias("split_silhouette"),
        F.coalesce("merge_with", F.lit("")).alias("merge_with"))


def final_taxonomy(draft: DataFrame, passport: DataFrame, topic: str = "topic_id") -> DataFrame:
    """Draft plus pillar, name, notes and action, sorted by pillar and size."""
    free = (F.col("confidence") != "LOW") & (F.col("merge_with") == "") & ~F.col("split_recommended")
    return draft.join(passport, topic).select(
        topic, "business_pillar", "business_name", "doc_count", "pct", "coherence", "confidence", "label_valid", "notes",
        "merge_with", "split_recommended", F.when(free, "APPROVED").otherwise("REVIEW").alias("action"),
    ).orderBy("business_pillar", F.desc("doc_count"), topic)


def action_text(tax: DataFrame) -> Column:
    """The longer action of the report: merge before split before review."""
    partners = F.filter(F.split("merge_with", r"\|"), lambda x: x != "")
    return (F.when(F.size(partners) > 0, F.concat(F.lit("Consider merge with ["), F.array_join(F.slice(partners, 1, 2), ", "), F.lit("]")))
            .when(F.col("split_recommended"), "Consider split").when(F.col("confidence") == "LOW", "Review - low confidence")
            .otherwise("Approved"))


def pillar_rollup(tax: DataFrame, pillar: str = "business_pillar", count: str = "doc_count") -> DataFrame:
    """Topics, rows and share per pillar, largest first."""
    total = tax.agg(F.sum(count).alias("t")).scalar()
    return (tax.groupBy(pillar).agg(F.count("*").alias("topics"), F.sum(count).alias("n"))
            .withColumn("pct", share(F.col("n"), total)).orderBy(F.desc("n"), pillar))


def pillar_platform_heatmap(tax: DataFrame, counts: DataFrame, platform: str, topic: str = "topic_id",
                            pillar: str = "business_pillar") -> DataFrame:
    """``(pillar, platform, n, intensity)`` from rows per topic and platform, intensity 0 to 255."""
    totals = tax.groupBy(pillar).agg(F.sum("doc_count").alias("total"))
    cells = counts.join(tax.select(topic, pillar), topic).groupBy(pillar, platform).agg(F.sum("n").alias("n"))
    value = F.floor(F.col("n") / F.greatest("total", F.lit(1)) * 400)
    return cells.join(totals, pillar).select(pillar, platform, "n", F.least(F.lit(255), value).cast("bigint").alias("intensity"))


def scorecard(tax: DataFrame, pairs: DataFrame, total: Column) -> DataFrame:
    """Eight rows ``(metric, value, status)``."""
    facts = tax.agg(
        F.count_distinct("business_pillar").alias("pillars"), F.count("*").alias("topics"), F.avg("coherence").alias("coherence"),
        F.count_if(F.col("confidence") == "HIGH").alias("high"), F.count_if(F.col("split_recommended")).alias("splits"),
        F.coalesce(F.sum("doc_count"), F.lit(0)).alias("covered"))
    merges = pairs.agg(F.count_if(F.col("recommendation") == "MERGE").alias("m")).scalar()
    facts = facts.withColumns({"total": total, "merges": merges})
    rate = F.when(F.col("total") > 0, (F.col("total") - F.col("covered")) * 100 / F.col("total")).otherwise(0.0)
    rows = [
        ("Total Tasks", F.col("total").cast("string"), F.lit("PASS")),
        ("Business Pillars", F.col("pillars").cast("string"), F.lit("PASS")),
        ("Topic Clusters", F.col("topics").cast("string"), F.lit("PASS")),
        ("Outlier Rate", F.concat(F.round(rate, 1).cast("string"), F.lit("%")), F.when(rate < 20, "PASS").otherwise("REVIEW")),
        ("Avg Coherence", F.round("coherence", 3).cast("string"), F.when(F.col("coherence") > 0.3, "GOOD").otherwise("MODERATE")),
        ("High Confidence Topics", F.concat_ws("/", F.col("high").cast("string"), F.col("topics").cast("string")), F.lit("GOOD")),
        ("Merge Candidates", F.col("merges").cast("string"), F.lit("PENDING")),
        ("Split Candidates", F.col("splits").cast("string"), F.lit("PENDING")),
    ]
    return facts.select(F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), v.alias("value"), s.alias("status")) for m, v, s in rows])))


def topic_explanations(terms: DataFrame, dist: DataFrame, reps: DataFrame, k: int = 10, topic: str = "topic_id",
                       label_words: int = 3) -> DataFrame:
    """Wide topic table: size, shares, ``kw_01 .. kw_k``, ``ctfidf_01 .. ctfidf_k``, three sample names."""
    padded = pad_terms(terms, dist, topic, k)
    ranks = list(range(1, k + 1))

    def at(rank: int, column: str, default) -> Column:
        return F.coalesce(F.max(F.when(F.col("rank") == rank, F.col(column))), F.lit(default))

    wide = padded.groupBy(topic).agg(
        *[at(r, "term", "").alias(f"kw_{r:02d}") for r in ranks],
        *[F.round(at(r, "score", 0.0), 6).alias(f"ctfidf_{r:02d}") for r in ranks])
    samples = reps.groupBy(topic).agg(*[at(r, "name", "").alias(f"sample_name_{r}") for r in (1, 2, 3)])
    labels = joined_terms(terms, topic, label_words, " | ", "topic_label")
    classified = dist.agg(F.sum(F.when(F.col(topic) != -1, F.col("n"))).alias("c")).scalar()
    total = dist.agg(F.sum("n").alias("c")).scalar()
    out = dist.select(topic, F.col("n").alias("topic_size")).join(labels, topic, "left").join(wide, topic).join(samples, topic, "left")
    return out.select(
        topic, F.when(F.col(topic) == -1, "outlier").otherwise(F.coalesce("topic_label", F.lit(""))).alias("topic_label"), "topic_size",
        F.round(share(F.col("topic_size"), total), 2).alias("pct_of_total"),
        F.when(F.col(topic) == -1, 0.0).otherwise(F.round(share(F.col("topic_size"), classified), 2)).alias("pct_of_classified"),
        *[f"kw_{r:02d}" for r in ranks], *[f"ctfidf_{r:02d}" for r in ranks],
        *[F.coalesce(f"sample_name_{r}", F.lit("")).alias(f"sample_name_{r}") for r in (1, 2, 3)])


# ------------------------------------------------------------- text per label


def action_mix(df: DataFrame, label: str, actions: dict[str, list[str]] | None = None, text: str = "cleaned_text") -> DataFrame:
    """``(label, action, pct)``: share of texts that hold any keyword of an action; texts may count for several."""
    actions = actions or K.ACTION_KEYWORDS
    hits = {a: reduce(Column.__or__, [contains_ci(F.col(text), k) for k in words]) for a, words in actions.items()}
    wide = df.groupBy(label).agg(F.count("*").alias("n"), *[F.count_if(h).alias(f"a{i}") for i, h in enumerate(hits.values())])
    return wide.select(label, F.inline(F.array(*[
        F.struct(F.lit(a).alias("action"), (F.col(f"a{i}") / F.col("n") * 100).alias("pct")) for i, a in enumerate(hits)])))


def text_metrics(df: DataFrame, c: str, label: str) -> DataFrame:
    """Words and characters per label; the median is the upper one of an even count.

    The median comes from the counts per number of words, not from sorting rows.
    """
    words = F.regexp_count(c, F.lit(r"[^\s\p{Z}\x{0B}\x{1C}-\x{1F}\x{85}]+"))
    rows = df.select(label, words.alias("words"), F.length(c).alias("chars"))
    counts = rows.groupBy(label, "words").agg(
        F.count("*").alias("n"), F.max("chars").alias("mx"), F.min("chars").alias("mn"), F.sum("chars").alias("sum_chars"))
    upto = Window.partitionBy(label).orderBy("words").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum("n").over(Window.partitionBy(label))
    ranked = counts.withColumns({"upto": F.sum("n").over(upto), "total": total})
    middle = F.min(F.when(F.col("upto") >= F.floor(F.col("total") / 2) + 1, F.col("words")))
    return ranked.groupBy(label).agg(
        F.sum("n").alias("n"), (F.sum(F.col("words") * F.col("n")) / F.sum("n")).alias("avg_words"),
        middle.cast("bigint").alias("median_words"), F.max("mx").cast("bigint").alias("max_chars"),
        F.min("mn").cast("bigint").alias("min_chars"), (F.sum("sum_chars") / F.sum("n")).alias("avg_chars"))


def xy_centroids(df: DataFrame, label: str, x: str = "x", y: str = "y") -> DataFrame:
    return df.groupBy(label).agg(F.avg(x).alias("x"), F.avg(y).alias("y"), F.count("*").alias("n"))
