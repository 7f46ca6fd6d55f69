"""Verification of generated text against computed figures (V1-V9).

Every step is a native column expression over a table of
(answer1, answer2, context): no UDF, so a billion narrations are one
projection.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookspark.functions.numbers import extract_numbers, is_small_count, normalise_number
from bookspark.functions.text import py_strip

# The warning and retry texts.
WARNING = ("⚠️ Unverified: this answer states a number not found in the computed "
           "figures ({}) — treat it with caution.")
RETRY = ("Your previous answer stated number(s) that do not appear anywhere in the "
         "figures above: {}. That is not allowed. You may only use numbers "
         "copied verbatim from the figures given, and you must never calculate a "
         "new number yourself — not even a simple subtraction. Write your answer "
         "again without inventing or computing any figure.")


def strip_reasoning(c: Column) -> Column:
    """V9: text after the first ``</think>`` (if any), stripped."""
    return py_strip(F.when(c.contains("</think>"), F.regexp_replace(c, r"(?s)^.*?</think>", ""))
                     .otherwise(c))


def context_numbers(context: Column) -> Column:
    """Normalised number forms present in the context (V1, V2)."""
    return F.array_distinct(F.transform(extract_numbers(context), normalise_number))


def unsupported_numbers(answer: Column, context: Column) -> Column:
    """V4: numbers of the answer (original form, in order) whose normal form is
    not among the context's; a bare single digit is never checked (V3)."""
    ctx = context_numbers(context)
    return F.filter(extract_numbers(answer),
                    lambda x: ~is_small_count(x) & ~F.array_contains(ctx, normalise_number(x)))


def unique_sorted(u: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(u)), ", ")


def flag_text(text: Column, unsupported: Column) -> Column:
    """V6: append the warning with the sorted distinct unsupported numbers."""
    parts = WARNING.split("{}")
    return F.concat(text, F.lit("\n\n" + parts[0]), unique_sorted(unsupported), F.lit(parts[1]))


def retry_prompt(base_prompt: Column, unsupported: Column) -> Column:
    """V7: the retry prompt for an outside generator."""
    parts = RETRY.split("{}")
    return F.concat(base_prompt, F.lit("\n\n" + parts[0]), unique_sorted(unsupported), F.lit(parts[1]))


def base_prompt(question: Column, context: Column) -> Column:
    """V7: the base prompt text built from a question and the finding context."""
    return F.concat(F.lit("Question from the owner: "), question,
                    F.lit("\n\nHere are the figures already calculated from the owner's sales records:\n\n"),
                    context, F.lit("\n\nAnswer directly, speaking to the owner as \"you\"."))


def resolve_attempts(df: DataFrame, answer1: str = "answer1", answer2: str = "answer2",
                     context: str = "context") -> DataFrame:
    """V5: attempt 1 clean -> verified; else attempt 2 clean -> verified and
    retried; else flagged, unverified, retried, with attempt 2's numbers.  A
    row with a bad attempt 1 and no attempt 2 yet is ``needs_retry``."""
    a1 = strip_reasoning(F.col(answer1))
    a2 = strip_reasoning(F.col(answer2))
    bad1 = unsupported_numbers(a1, F.col(context))
    bad2 = unsupported_numbers(a2, F.col(context))
    ok1 = F.size(bad1) == 0
    ok2 = F.size(bad2) == 0
    has2 = F.col(answer2).isNotNull()
    state = (F.when(ok1, "verified").when(~has2, "needs_retry")
              .when(ok2, "verified_after_retry").otherwise("flagged"))
    text = (F.when(ok1, a1).when(~has2, F.lit(None).cast("string")).when(ok2, a2)
             .otherwise(flag_text(a2, bad2)))
    unsupported = (F.when(ok1, F.array().cast("array<string>"))
                    .when(~has2, bad1).when(ok2, F.array().cast("array<string>")).otherwise(bad2))
    return df.select(
        "*",
        state.alias("state"),
        text.alias("text"),
        (ok1 | (has2 & ok2)).alias("verified"),
        unsupported.alias("unsupported"),
        (~ok1 & has2).alias("retried"))


def model_comparison(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """V8 / K5 over ``(model, question, run, text, verified, unsupported,
    retried, seconds)``: per model - answers, mean length, mean seconds,
    unsupported numbers in total, retried, fixed by the retry, still
    unverified; and the answers side by side as a long table, one row per
    question, run and model."""
    per_model = results.groupBy("model").agg(
        F.count(F.lit(1)).alias("answers"),
        F.avg(F.length("text")).alias("mean_length"),
        F.avg("seconds").alias("mean_seconds"),
        F.sum(F.size(F.coalesce("unsupported", F.array().cast("array<string>")))).cast("bigint")
         .alias("unsupported_total"),
        F.count_if(F.col("retried")).alias("retried"),
        F.count_if(F.col("retried") & F.col("verified")).alias("fixed_by_retry"),
        F.count_if(~F.col("verified")).alias("unverified"))
    side = results.groupBy("question", "run", "model").agg(F.first("text").alias("text"))
    return per_model, side
