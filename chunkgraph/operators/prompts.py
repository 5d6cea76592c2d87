"""Prompt assembly under a length budget, templates, and the answer log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The texts that a prompt is made of.
HEADER = "QUERY: {query}\n\nRELATED EVIDENCE PATHS:"
MORE = "... (%d more paths truncated)"
OPENING = 'You are a knowledgeable and professional AI assistant. A user has asked the following question:\n\nQuestion: "{query}"\n\n'
BASED_ON = "Based on the following relevant information:\n\n"
RULE = "\n\n" + "=" * 50
USER_SECTION = "RELEVANT INFORMATION FROM USER DOCUMENTS:\n"
MAIN_SECTION = "RELEVANT GENERAL KNOWLEDGE:\n"
CLOSING = "\n\nPlease provide a comprehensive, accurate, and helpful response to the user's question."
NO_CONTEXT = """No specific relevant information was found in the available knowledge base for this query.

Please:
1. Acknowledge that specific information is not available in the current knowledge base
2. Provide any general guidance or suggestions that might be helpful
3. Suggest how the user might rephrase their question or what additional context might help
4. Maintain a supportive and professional tone"""
SYSTEM = (
    "You are a knowledgeable and helpful AI assistant. Use the provided context to help answer the user's question. "
    "If the context is incomplete, make your best effort to provide a coherent and helpful response based on your general knowledge. "
    "Never say 'I don't know'."
)


def three_places(x: Column) -> Column:
    """A score of six places at three, as C and Python print it: by the double's exact value, even where just between.

    Java rounds the shortest decimal instead, so that 0.0005 less a bit goes up. Only a value whose decimal ends on half a
    thousandth can differ; its distance to that half is exact in doubles, as its two parts have 24 and 29 bits."""
    thousandths = F.floor(x * 1000 + 1e-9)
    half = F.abs(x * 1000 - thousandths - 0.5) < 1e-7
    high = x.cast("float").cast("double")
    beyond = (high * 2000 - (2 * thousandths + 1)) + (x - high) * 2000
    up = (beyond > 0) | ((beyond == 0) & (thousandths % 2 == 1))
    return F.format_string("%.3f", F.when(half, (thousandths + up.cast("int")) / F.lit(1000.0)).otherwise(x))


def path_line(rank: Column, score: Column, text: Column) -> Column:
    """``<rank>. [Score: <score to three places>] <text>``"""
    return F.concat(rank.cast("string"), F.lit(". [Score: "), three_places(F.round(score, 6)), F.lit("] "), text)


def evidence_prompts(queries: DataFrame, paths: DataFrame, max_paths: int = 10, max_length: int = 4000, text: str = "full_text") -> DataFrame:
    """(query_id, query, n_paths, prompt) from paths with path_rank, score and the whole texts of their nodes.

    Lines are added while the header's and their lengths stay within ``max_length``, newlines between lines not
    counted; the first that doesn't fit ends the list, and a last line tells how many are left out."""
    head = F.replace(F.lit(HEADER), F.lit("{query}"), F.col("query"))
    kept = paths.filter(F.col("path_rank") <= max_paths).join(queries.select("query_id", "query"), "query_id")
    lines = kept.select("query_id", "path_rank", path_line(F.col("path_rank"), F.col("score"), F.col(text)).alias("line"), F.length(head).alias("head"))
    order = Window.partitionBy("query_id").orderBy("path_rank")
    used = lines.withColumn("used", F.col("head") + F.sum(F.length("line")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy("query_id")
    cut = used.withColumn("cut", F.min(F.when(F.col("used") > max_length, F.col("path_rank"))).over(whole)).withColumn("n", F.count("*").over(whole))
    shown = cut.filter(F.col("cut").isNull() | (F.col("path_rank") < F.col("cut")))
    body = shown.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path_rank", "line"))), lambda s: s["line"]), "\n").alias("body"))
    counts = cut.groupBy("query_id").agg(F.max("n").alias("n"), F.max("cut").alias("cut"))
    rows = queries.select("query_id", "query").join(counts, "query_id", "left").join(body, "query_id", "left")
    more = F.when(F.col("cut").isNotNull(), F.format_string(MORE, (F.col("n") - F.col("cut") + 1).cast("int")))
    return rows.select("query_id", "query", F.coalesce("n", F.lit(0)).cast("int").alias("n_paths"), F.concat_ws("\n", head, "body", more).alias("prompt"))


def stripped(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def dual_context(user: Column, main: Column, query: Column) -> Column:
    """The question, then the user's context before the shared one; a rule stands right before the first section,
    blank lines between. Without either, what to do then."""
    sections = F.array_compact(F.array(*[F.when(F.length(stripped(t)) > 0, F.concat(F.lit(name), stripped(t))) for name, t in ((USER_SECTION, user), (MAIN_SECTION, main))]))
    known = F.concat(F.lit(BASED_ON + RULE), F.array_join(sections, "\n\n"), F.lit(CLOSING))
    return F.concat(F.replace(F.lit(OPENING), F.lit("{query}"), F.coalesce(query, F.lit(""))), F.when(F.size(sections) == 0, F.lit(NO_CONTEXT)).otherwise(known))


def rag_prompt(context: Column, question: Column, system: Column | None = None) -> Column:
    """System text (``SYSTEM`` unless another is given), context and question, a blank line between."""
    system = F.lit(SYSTEM) if system is None else system
    return F.concat_ws("\n\n", F.concat(F.lit("SYSTEM: "), system), F.concat(F.lit("CONTEXT: "), context), F.concat(F.lit("USER QUESTION: "), question), F.lit("ASSISTANT:"))


def truncate_prompt(prompt: Column, max_chars: int, system: Column | None = None) -> Column:
    """The first characters of the stripped prompt, after the system text if there is one."""
    cut = F.substring(F.trim(prompt), 1, max_chars)
    return cut if system is None else F.trim(F.concat(system, F.lit("\n\n"), cut))


def probe_cache(requests: DataFrame, log: DataFrame) -> DataFrame:
    """Requests (user_id, query, ...) with the first logged llm_response of the same user and query, null for none."""
    first = log.groupBy("user_id", "query").agg(F.min_by("llm_response", F.struct("created_at", "entry_id")).alias("llm_response"), F.lit(True).alias("hit"))
    return requests.join(first, ["user_id", "query"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def cache_misses(requests: DataFrame, log: DataFrame) -> DataFrame:
    return requests.join(log.select("user_id", "query").distinct(), ["user_id", "query"], "left_anti")


def extractive_answer(prompt: Column, max_chars: int = 512) -> Column:
    """An offline stand-in for a text model: the beginning of the prompt's context."""
    return F.substring(F.regexp_extract(prompt, r"(?s)CONTEXT: (.*?)\n\nUSER QUESTION:", 1), 1, max_chars)
