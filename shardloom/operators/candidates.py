"""Prompts compiled from descriptions, candidate plans and eligibility."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardloom.functions import expressions as X

# The opening words of every prompt, and the characters that a prompt may hold.
PROMPT_CHARACTERS = r"^[a-z0-9 ,.\-]+$"
PROMPT_BASE = "close-up grayscale industrial inspection photograph of a flat manufactured surface"


def compile_prompts(records: DataFrame, normal: str = "normal") -> DataFrame:
    """One bounded prompt for each defect record (image_id, label, exemplar_rank, response), from it and the normal record of its rank.

    Background terms come from the normal description, else from the defect's; a description with problems gives
    the neutral template and is not called guided.  problem is set where the text breaks its bound.
    """
    defect = records.where(F.col("label") != normal).select("image_id", "label", "exemplar_rank", F.col("response").alias("_d"))
    other = records.where(F.col("label") == normal).select("exemplar_rank", F.col("image_id").alias("_normal"), F.col("response").alias("_n"))
    both = defect.join(other, "exemplar_rank", "left")
    bad = X.description_problems(F.col("_d"), ("shape", "texture"))
    usable = F.col("_normal").isNotNull() & (F.size(X.description_problems(F.col("_n"), ("texture", "illumination"))) == 0)
    none = F.array().cast("array<string>")
    staged = both.withColumns({"_bad": bad, "_mark": X.extract_terms(F.col("_d")), "_back": X.extract_terms(F.col("_n")), "_usable": usable})
    guided = F.size("_bad") == 0
    mark = lambda c: F.when(guided, F.col(f"_mark.{c}")).otherwise(none)
    pick = lambda c: F.when(F.col("_usable") & (F.size(f"_back.{c}") > 0), F.col(f"_back.{c}")).otherwise(mark(c))
    terms = staged.withColumns({"_texture": pick("texture"), "_light": pick("illumination"), "_shape": mark("shape")})
    word = X.humanise_label(F.col("label"))
    shape = F.array_join("_shape", " ")
    defect_part = F.concat(F.lit("showing one "), word, F.lit(" defect"), F.when(shape != "", F.concat(F.lit(" as a "), shape, F.lit(" mark"))).otherwise(""))
    full = F.array_join(F.concat(F.array(F.lit(PROMPT_BASE)), "_texture", "_light", F.array(defect_part, F.lit("sharp focus"), F.lit("no text"))), ", ")
    plain = F.concat(F.lit(PROMPT_BASE + ", showing one "), word, F.lit(" defect, sharp focus, no text"))
    text = F.when(guided, full).otherwise(plain)
    out = terms.withColumn("text", text)
    fits = (F.length("text") <= X.MAX_PROMPT_CHARS) & F.col("text").rlike(PROMPT_CHARACTERS)
    return out.select(
        F.concat_ws("-", "label", "exemplar_rank").alias("prompt_id"), "label", "exemplar_rank", "text", guided.alias("guided"), F.array_join("_bad", "; ").alias("fallback_reason"),
        F.struct(F.col("_texture").alias("texture"), F.col("_light").alias("illumination"), F.col("_shape").alias("shape")).alias("terms"),
        F.array_compact(F.array("image_id", "_normal")).alias("source_image_ids"), F.when(~fits, "prompt violates its bound").alias("problem"),
    )


def outside_budget(descriptions: DataFrame, selected: DataFrame, item: str) -> DataFrame:
    """Descriptions of items that were not selected for training."""
    return descriptions.join(selected.select(item), item, "left_anti")


def candidate_plan(roles: DataFrame, prompts: DataFrame, per_role: int = 32) -> DataFrame:
    """candidate_id, intended_label, prompt_id, prompt, seed.  roles: label, role (from 0); prompts: label, prompt_id, text, exemplar_rank.

    Candidate i of role r takes prompt i mod P (its rank) and seed 100000 r + i.
    """
    n = prompts.groupBy("label").agg(F.count(F.lit(1)).alias("_p"))
    slots = roles.join(n, "label").withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(per_role - 1))))
    numbered = slots.withColumn("exemplar_rank", F.pmod("_i", "_p").cast("long"))
    ranked = prompts.select("label", F.col("exemplar_rank").cast("long"), "prompt_id", F.col("text").alias("prompt"))
    return numbered.join(ranked, ["label", "exemplar_rank"]).select(
        F.format_string("syn_%s_%02d", "label", "_i").alias("candidate_id"), F.col("label").alias("intended_label"), "prompt_id", "prompt", (F.lit(100000) * F.col("role") + F.col("_i")).cast("long").alias("seed")
    )


def candidate_eligibility(rows: DataFrame, real: DataFrame, *, side: int, item: str = "candidate_id", order: str = "ord", digest: str = "digest") -> DataFrame:
    """item, status, reason of candidates (h, w, finite, digest; a null digest was not decoded), by ordered rules.

    'Earlier' means a smaller `order` among candidates that passed the rules before.
    """
    known = real.select(F.col(digest).alias("_real")).distinct()
    joined = rows.join(known, F.col(digest) == F.col("_real"), "left")
    early = (
        F.when(F.col(digest).isNull(), "decode-failure").when((F.col("h") != side) | (F.col("w") != side), F.concat(F.lit("dimensions "), "h", F.lit("x"), "w"))
        .when(~F.col("finite"), "non-finite values").when(F.col("_real").isNotNull(), "exact duplicate of a real item")
    )
    staged = joined.withColumn("_early", early)
    first = staged.where("_early is null").groupBy(digest).agg(F.min_by(item, F.struct(order, item)).alias("_first"))
    reason = F.coalesce("_early", F.when(F.col(item) != F.col("_first"), "exact duplicate of an earlier candidate"), F.lit(""))
    return staged.join(first, digest, "left").withColumn("reason", reason).select(item, "intended_label", F.when(F.col("reason") == "", "eligible").otherwise("rejected").alias("status"), "reason")


def generation_status(rows: DataFrame, labels: DataFrame, *, expected: int = 32, minimum: int = 24) -> DataFrame:
    """label, attempted, usable, complete, shortfall of every label of `labels`."""
    n = rows.groupBy(F.col("intended_label").alias("label")).agg(F.count(F.lit(1)).alias("attempted"), F.count_if(F.col("status") == "eligible").alias("usable"))
    full = labels.select("label").join(n, "label", "left").na.fill(0, ["attempted", "usable"])
    done = (F.col("usable") >= minimum) & (F.col("attempted") == expected)
    text = F.format_string(f"%s: %d usable of %d attempts (minimum {minimum})", "label", "usable", "attempted")
    return full.select("label", "attempted", "usable", done.alias("complete"), F.when(done, "").otherwise(text).alias("shortfall"))


def disposition_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status", "reason").agg(F.count(F.lit(1)).alias("n"))
