"""Incremental ingestion with Structured Streaming.

* :func:`stream_notice_chunks` – landed pages are stripped, cut and
  decorated as they arrive, and appended to a Parquet table.  The
  transforms are stateless, so each micro-batch equals the batch plan over
  the same files.
* :func:`stream_session_log` – chat messages are routed and the storable
  ones appended to the session log with ``foreachBatch``.

Both use ``trigger(availableNow=True)``: all files present are processed
in bounded micro-batches and the query stops; the checkpoint under the
shared checkpoint folder makes a rerun pick up only new files and makes a
lost executor or driver restart replay from the last committed batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions.text import strip_html
from ..operators.chunking import notice_rows
from ..operators.sessions import ROUTE_HISTORY, ROUTE_RESET, loggable, route_messages
from ..sources.pages import first_element_text


def _file_stream(spark: SparkSession, path: str, schema: T.StructType, max_files: int) -> DataFrame:
    """Parquet files landing under a directory.  A file stream wants a
    directory or a pattern; a table's path, which may be one file or a folder
    of files, is given as the pattern that matches nothing but itself."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    if path.rstrip("/").endswith(".parquet"):
        folder, slash, name = path.rstrip("/").rpartition("/")
        path = f"{folder}{slash}[{name[0]}]{name[1:]}"
    return reader.parquet(path)


def stream_notice_chunks(
    spark: SparkSession,
    landing: str,
    schema: T.StructType,
    sink: str,
    checkpoint: str,
    max_files: int = 16,
) -> None:
    """landing pages (page_id, url, html) -> chunk rows, title included,
    appended at ``sink``: the batch plan's rows."""
    pages = _file_stream(spark, landing, schema, max_files)
    title = first_element_text("html", "title")
    text = pages.select("page_id", "url", title.alias("titulo"), strip_html("html").alias("texto"))
    rows = notice_rows(text, "texto", "url", keep=["page_id", "url", "titulo"])
    query = (
        rows.writeStream.format("parquet")
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def stream_session_log(
    spark: SparkSession,
    landing: str,
    schema: T.StructType,
    log_path: str,
    checkpoint: str,
    session_col: str = "conv_id",
    seq_col: str = "turn",
    text_col: str = "text",
    max_files: int = 16,
    derive=None,
) -> None:
    """Messages -> routed -> storable ones appended to the session log.

    ``foreachBatch`` writes each micro-batch into its own ``batch_id=``
    folder and overwrites that folder, so a replayed batch replaces itself.
    """
    messages = _file_stream(spark, landing, schema, max_files)
    if derive is not None:
        messages = derive(messages)
    routed = route_messages(messages, text_col)

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = loggable(batch).select(
            F.col(session_col).alias("session_id"), F.col(seq_col).alias("seq"), F.col("clean_text").alias("prompt"), "route"
        )
        write_log_batch(rows, log_path, batch_id)

    query = (
        routed.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def stream_index(
    spark: SparkSession,
    landing: str,
    schema: T.StructType,
    index: str,
    checkpoint: str,
    embed,
    max_files: int = 16,
) -> None:
    """Landed pages -> chunks -> vectors of chunks not seen before, appended
    to the index ``(digest, page_content, embedding)`` at ``index``.

    Pages landed again repeat their chunks; a chunk whose digest is in the
    state is dropped, whichever micro-batch brought it first.  ``embed(df,
    text_col, out_col)`` adds the vectors.  Every micro-batch replaces its
    own folder, so a replayed one changes nothing."""
    pages = _file_stream(spark, landing, schema, max_files)
    title = first_element_text("html", "title")
    text = pages.select("url", title.alias("titulo"), strip_html("html").alias("texto"))
    rows = notice_rows(text, "texto", "url", keep=["url", "titulo"])
    chunks = rows.select(F.sha2("resumen", 256).alias("digest"), F.col("resumen").alias("page_content"))
    query = (
        chunks.dropDuplicates(["digest"])
        .writeStream.foreachBatch(lambda batch, batch_id: write_log_batch(embed(batch, "page_content", "embedding"), index, batch_id))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


EPOCHS_SCHEMA = "{session} bigint, {seq} bigint, route string, epoch bigint, turn_no bigint"
EPOCH_STATE = "epoch bigint, turn_no bigint"


def _advance(rows: list[tuple], epoch: int, turn_no: int) -> tuple[list[tuple], int, int]:
    """Epoch and turn number of routed messages ``(seq, route)`` in order,
    from a conversation's state, and the state after them."""
    out = []
    for seq, route in rows:
        if route == ROUTE_RESET:
            out.append((seq, route, epoch, None))
            epoch, turn_no = epoch + 1, 0
        elif route == ROUTE_HISTORY:
            out.append((seq, route, epoch, None))
        else:
            turn_no += 1
            out.append((seq, route, epoch, turn_no))
    return out, epoch, turn_no


def stream_session_epochs(
    spark: SparkSession,
    landing: str,
    schema: T.StructType,
    sink: str,
    checkpoint: str,
    session_col: str = "conv_id",
    seq_col: str = "turn",
    text_col: str = "text",
    max_files: int = 16,
    derive=None,
) -> None:
    """The streaming twin of ``sessions.session_epochs``: each conversation's
    epoch and turn number are kept as state over micro-batches.

    Messages arrive in order over the micro-batches (within one they are
    sorted); a task holds one conversation's messages of one micro-batch.  The
    state is two numbers a conversation, in Spark's state store under the
    checkpoint; every micro-batch replaces its own folder, so that a replayed
    one changes nothing."""
    messages = _file_stream(spark, landing, schema, max_files)
    if derive is not None:
        messages = derive(messages)
    routed = route_messages(messages.where(F.col(session_col).isNotNull()), text_col).select(session_col, seq_col, "route")
    names = [session_col, seq_col, "route", "epoch", "turn_no"]

    def number(key, frames, state):
        import pandas as pd

        rows = sorted(row for pdf in frames for row in zip(pdf[seq_col].tolist(), pdf["route"].tolist(), strict=True))
        epoch, turn_no = state.get if state.exists else (0, 0)
        out, epoch, turn_no = _advance(rows, epoch, turn_no)
        state.update((epoch, turn_no))
        yield pd.DataFrame([(key[0], *row) for row in out], columns=names).astype({"turn_no": "Int64"})

    numbered = routed.groupBy(session_col).applyInPandasWithState(
        number, EPOCHS_SCHEMA.format(session=session_col, seq=seq_col), EPOCH_STATE, "append", GroupStateTimeout.NoTimeout
    )
    query = (
        numbered.writeStream.foreachBatch(lambda batch, batch_id: write_log_batch(batch, sink, batch_id))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def write_log_batch(rows: DataFrame, log_path: str, batch_id: int) -> None:
    """One micro-batch of the log; writing it again changes nothing."""
    rows.write.mode("overwrite").parquet(f"{log_path}/batch_id={batch_id}")
