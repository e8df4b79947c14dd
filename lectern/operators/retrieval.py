"""Retrieval-augmented prompt assembly over a batch of questions.

questions -> embed -> k-NN over the chunk table -> ordered context ->
prompt.  Generation is a caller-supplied function; the engine only builds
the prompts (and can run the function through ``mapInPandas``).
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import fill_template
from ..params import CONTEXT_SEPARATOR, FEWSHOT_SEPARATOR, OK_STATUS, RETRIEVER_K
from .aggregates import ordered_concat
from .knn import attach_metadata, knn

# Prompt with a conversation's memory.
HISTORY_TEMPLATE = "Conversation so far:\n{history}\n<context>\n{context}\n</context>\nQuestion: {input}"

# Default prompt template: {context} receives the stuffed chunks and
# {input} the question.  Callers pass their own template.
DEFAULT_TEMPLATE = (
    "Answer the question using only the context below. "
    "If the context does not contain the answer, say so.\n"
    "<context>\n{context}\n</context>\n"
    "Question: {input}"
)


def retrieve(
    index: DataFrame,
    questions: DataFrame,
    embed: Callable[[DataFrame], DataFrame],
    k: int = RETRIEVER_K,
    chunk_id: str = "chunk_id",
    chunk_text: str = "page_content",
    chunk_vec: str = "embedding",
    q_id: str = "qid",
    q_vec: str = "qvec",
) -> DataFrame:
    """Top-k chunks per question from a saved index (``files.load_vectors``).

    ``embed`` adds the ``q_vec`` column to the questions.  The search reads
    ids and vectors; the texts are joined to the hits alone."""
    hits = knn(index, embed(questions), k=k, id_col=chunk_id, vec_col=chunk_vec, q_id=q_id, q_vec=q_vec)
    return attach_metadata(hits, index, chunk_id, [chunk_text])


def stuff_context(hits: DataFrame, q_id: str = "qid", text_col: str = "page_content", sep: str = CONTEXT_SEPARATOR) -> DataFrame:
    """Page contents in rank order joined by a blank line, one row per
    question.  Groups hold at most k rows."""
    return ordered_concat(hits, [q_id], "rank", text_col, sep, "context", count_col="n_hits")


def build_prompts(
    questions: DataFrame,
    context: DataFrame,
    q_id: str = "qid",
    q_text: str = "question",
    template: str = DEFAULT_TEMPLATE,
    history: DataFrame | None = None,
    session_col: str | None = None,
) -> DataFrame:
    """One prompt per question; questions without hits keep an empty
    context.  History, when given, fills a ``{history}`` slot and is
    joined by session."""
    joined = questions.join(context, q_id, "left")
    slots = {"context": F.coalesce(F.col("context"), F.lit("")), "input": F.col(q_text)}
    if history is not None and session_col:
        joined = joined.join(history, session_col, "left")
        slots["history"] = F.coalesce(F.col("history"), F.lit(""))
    return joined.withColumn("prompt", fill_template(template, slots))


def fewshot_prompt(questions: DataFrame, examples: list[str], suffix: str, q_text: str = "question") -> DataFrame:
    """Examples, then the suffix with ``{input}`` filled, joined by blank
    lines."""
    head = FEWSHOT_SEPARATOR.join(examples)
    filled = fill_template(suffix, {"input": F.col(q_text)})
    if head:
        filled = F.concat(F.lit(head + FEWSHOT_SEPARATOR), filled)
    return questions.withColumn("prompt", filled)


def generate(df: DataFrame, prompt_col: str, fn: Callable[[list[str]], list[str]], out_col: str) -> DataFrame:
    """Run a caller-supplied batch text generator over ``prompt_col``."""
    schema = T.StructType(df.schema.fields + [T.StructField(out_col, T.StringType())])

    def run(batches):
        for pdf in batches:
            out = pdf.copy()
            out[out_col] = list(fn(pdf[prompt_col].fillna("").tolist())) if len(pdf) else []
            yield out

    return df.mapInPandas(run, schema)


def prompt_steps(df: DataFrame, steps: list[tuple[str, str, str]], fn: Callable[[list[str]], list[str]]) -> DataFrame:
    """Chained prompt columns: each step is (template, input column, output
    column); a step's template may use any earlier column."""
    out = df
    for template, in_col, out_col in steps:
        out = out.withColumn(f"_{out_col}_prompt", fill_template(template, {in_col: F.col(in_col)}))
        out = generate(out, f"_{out_col}_prompt", fn, out_col).drop(f"_{out_col}_prompt")
    return out


def concat_pages(
    pages: DataFrame,
    doc_col: str = "doc_id",
    page_col: str = "page_no",
    status_col: str = "status",
    text_col: str = "text",
    ok_status: int = OK_STATUS,
    bucket_width: int = 1024,
) -> DataFrame:
    """Text of a paged document: each page followed by a newline, in page
    order.  Only documents fetched with ``ok_status`` carry text; the others
    get NULL text.  Two-level aggregation spreads very long documents."""
    ok = pages.withColumn(
        "_page", F.when(F.col(status_col) == ok_status, F.concat(F.coalesce(F.col(text_col), F.lit("")), F.lit("\n")))
    )
    return ordered_concat(ok, [doc_col], page_col, "_page", "", "text", bucket_width=bucket_width, count_col="n_pages")
