"""Chat formatting: typed content parts become one marked text per turn, with a loss mask.

A turn is ``<|start|>ROLE<|sep|>TEXT<|end|>`` and a line end. Inside roles and texts a backslash is
doubled and the first character of a control string becomes a backslash and a letter, so no text can
look like a mark and ``unescape`` gives the text back exactly.

A part is a struct (type, text, ref, size). Text parts are joined as they are. An image, audio or
document part becomes a placeholder ``<|image:1|>`` numbered within its turn, and an attachment
(type, ref, offset of the placeholder in the turn, expanded tokens) is recorded: an image of ``size``
pixels takes 1 token per 784, audio 25 per second, a document 1 per 4 bytes, each at least 1.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillwork.llm.common import stored
from quillwork.llm.registry import llm_query
from quillwork.sources.tables import table

PART = "struct<type:string,text:string,ref:string,size:bigint>"
START, SEPARATOR, END = "<|start|>", "<|sep|>", "<|end|>\n"
#: Control strings of common templates; all begin with ``<`` or ``[``.
CONTROL = r"<\||</?s>|<</?SYS>>|\[/?INST\]"
#: Units that one token of an attachment stands for.
UNITS_PER_TOKEN = {"image": 784.0, "audio": 0.04, "document": 4.0}

_TURN = re.compile(r"<\|start\|>(.*?)<\|sep\|>(.*?)<\|end\|>\n", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_PLAIN = {"\\": "\\", "l": "<", "b": "["}


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    angles = F.regexp_replace(doubled, r"<(?=\||/?s>|</?SYS>>)", r"\\l")
    return F.regexp_replace(angles, r"\[(?=/?INST\])", r"\\b")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _PLAIN[m[1]], text)


def _visit(state: Column, part: Column) -> Column:
    """One step of the flattening: the state is (text so far, attachments so far)."""
    kind = F.coalesce(part["type"], F.lit("text"))
    number = F.size(state["attachments"]) + 1
    holder = F.format_string("<|%s:%d|>", kind, number)
    units = F.coalesce(part["size"], F.lit(0)).cast("double")
    each = F.coalesce(
        F.when(kind == "image", UNITS_PER_TOKEN["image"]).when(kind == "audio", UNITS_PER_TOKEN["audio"]),
        F.lit(UNITS_PER_TOKEN["document"]),
    )
    attachment = F.struct(
        kind.alias("type"),
        part["ref"].alias("ref"),
        F.length(state["body"]).alias("offset"),
        F.greatest(F.ceil(units / each), F.lit(1)).cast("bigint").alias("tokens"),
    )
    is_text = ~kind.isin(*UNITS_PER_TOKEN)
    return F.struct(
        F.concat(
            state["body"], F.when(is_text, escape(F.coalesce(part["text"], F.lit("")))).otherwise(holder)
        ).alias("body"),
        F.when(is_text, state["attachments"])
        .otherwise(F.concat(state["attachments"], F.array(attachment)))
        .alias("attachments"),
    )


def format_turns(turns: DataFrame, parts: str = "parts") -> DataFrame:
    """``conv_id, turn, role, formatted, loss_start, loss_end, attachments`` for rows of typed parts.

    ``turns`` has conv_id, turn, role and ``parts``, an array of PART; unknown types are text. The
    loss mask of an assistant turn is its text, as code points of ``formatted`` (else both are 0). A
    null array is an empty text, a null role an empty one. Everything is one expression per row.
    """
    empty = F.struct(
        F.lit("").alias("body"),
        F.array().cast("array<struct<type:string,ref:string,offset:int,tokens:bigint>>").alias("attachments"),
    )
    flat = F.aggregate(F.coalesce(F.col(parts), F.array().cast(f"array<{PART}>")), empty, _visit)
    role = F.coalesce(F.col("role"), F.lit(""))
    head = F.concat(F.lit(START), escape(role), F.lit(SEPARATOR))
    learned = role == "assistant"
    return (
        turns.select("conv_id", "turn", role.alias("role"), flat.alias("_flat"), head.alias("_head"), learned.alias("_learned"))
        .select(
            "conv_id", "turn", "role",
            F.concat("_head", F.col("_flat.body"), F.lit(END)).alias("formatted"),
            F.when(F.col("_learned"), F.length("_head")).otherwise(0).alias("loss_start"),
            F.when(F.col("_learned"), F.length("_head") + F.length("_flat.body")).otherwise(0).alias("loss_end"),
            F.col("_flat.attachments").alias("attachments"),
        )
    )


def text_parts(conversations: DataFrame) -> DataFrame:
    """The table's plain texts as one text part per row; null is empty. Other columns are left out."""
    part = F.struct(
        F.lit("text").alias("type"), F.coalesce(F.col("text"), F.lit("")).alias("text"),
        F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("size"),
    )
    return conversations.select(
        F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.col("role").cast("string"),
        F.array(part).alias("parts"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation from formatted turns: what the text says, parsed and unescaped.

    Turns of a conversation come sorted (null turns first; equal turns by their text) and are hashed
    as they pass, so a conversation of any length takes the memory of one turn. Repeated rows are
    turns of their own; a null conv_id is one conversation; an empty table gives no rows.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                        ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def parse(batches):
        current, state = None, None

        def row():
            turns, learned, numbers = state
            cells = (current[0], numbers[0], turns.hexdigest(), numbers[1], learned.hexdigest(), numbers[2])
            return pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(cells, schema)], schema=schema)

        for batch in batches:
            done = []
            for conv, text, begin, end in zip(*(c.to_pylist() for c in batch.columns)):
                if current != (conv,):
                    if state:
                        done.append(row())
                    current, state = (conv,), (hashlib.sha256(), hashlib.sha256(), [0, 0, 0])
                turns, learned, numbers = state
                for role, body in _TURN.findall(text):
                    turns.update(f"{unescape(role)}\n{unescape(body)}\n".encode())
                    numbers[0] += 1
                loss = unescape(text[begin:end])
                learned.update(loss.encode())
                numbers[1] += len(loss)
                numbers[2] += len(text)
            if done:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
        if state:
            yield row()

    width = int(formatted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        formatted.select("conv_id", "turn", "formatted", "loss_start", "loss_end")
        .repartition(width, "conv_id")
        .sortWithinPartitions("conv_id", "turn", "formatted")
        .select("conv_id", "formatted", "loss_start", "loss_end")
        .mapInArrow(
            parse,
            "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
        )
    )


_MARKS = len(START) + len(SEPARATOR) + len(END)


@llm_query(
    "op2_chat_format",
    rf"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                    UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'),
                                                    (-7, 1, 'assistant', '</s>[INST] ok [/INST]')))
        SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
               CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
               sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn)) AS loss_sha256,
               CAST(sum({_MARKS} + length(role) + length(text)
                        + length(text) - length(replace(text, '\', ''))
                        + len(regexp_extract_all(text, '{CONTROL}'))) AS BIGINT) AS formatted_chars
        FROM t GROUP BY conv_id""",
)
def op2_chat_format(spark, sf):
    """All conversations and conversation -7, formatted, written, and read back from the files."""
    hard = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame(
        [(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string"
    )
    turns = text_parts(table(spark, sf, "conversations")).unionByName(text_parts(extra))
    return read_back(stored(format_turns(turns), "chat"))
