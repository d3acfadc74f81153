"""Chat formatting by event-sourced reconstruction.

A conversation is a log of events, dealt by conversation and sorted by sequence
number.  Folding the log rebuilds the final messages: ``message`` opens one,
``delta`` appends to one, ``edit`` replaces its text, ``regenerate`` empties an
answer and drops what followed it.  The messages are then rendered with a
template that marks turns; control strings inside texts and roles are escaped
by one more backslash, which parsing takes away again.

The fold streams over rows sorted by (conversation, sequence): a task holds one
open conversation at a time.

Defined results: null texts and roles are empty; equal sequence numbers are
ordered by role, then text; repeated rows are repeated turns; an event for a
message that does not exist is skipped; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.store import table

OPEN, CLOSE = "<|turn|>", "<|end|>\n"
#: Control strings of common chat templates, besides this template's own <|...|>.
CONTROL = re.compile(r"([<\[])(\\*)(\||/?s>|/?INST\]|</?SYS>>)")
_ESCAPED = re.compile(r"([<\[])\\(\\*)(\||/?s>|/?INST\]|</?SYS>>)")
_TURN = re.compile(r"<\|turn\|>(.*)\n")
LEARNED = "assistant"
EVENTS = "conv_id long, seq long, kind string, target long, role string, text string"
PLANTED = "</s>[INST] ok [/INST]"


def escaped(text: str) -> str:
    return CONTROL.sub(r"\1\\\2\3", text)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def _role_out(role: str) -> str:
    return escaped(role.replace("%", "%25").replace("\n", "%0A"))


def _role_in(role: str) -> str:
    return unescaped(role).replace("%0A", "\n").replace("%25", "%")


def fold(events: Iterable[tuple]) -> list[tuple[str, str]]:
    """Final (role, text) messages of one conversation's (seq, kind, target, role, text) events, in order."""
    order: list[int] = []
    messages: dict[int, tuple[str, list[str]]] = {}
    for serial, (seq, kind, target, role, text) in enumerate(events):
        if kind == "message":
            key = seq if seq not in messages else ("again", serial)
            order.append(key)
            messages[key] = (role or "", [text or ""])
        elif target in messages:
            who, parts = messages[target]
            if kind == "delta":
                parts.append(text or "")
            elif kind == "edit":
                messages[target] = (who, [text or ""])
            elif kind == "regenerate":
                at = order.index(target)
                for later in order[at + 1 :]:
                    del messages[later]
                del order[at + 1 :]
                messages[target] = (who, [text or ""])
    return [(messages[k][0], "".join(messages[k][1])) for k in order]


def render(messages: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the spans under the loss mask (code points)."""
    parts, spans, at = [], [], 0
    for role, text in messages:
        head, body = f"{OPEN}{_role_out(role)}\n", escaped(text)
        parts += (head, body, CLOSE)
        if role == LEARNED:
            spans.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The messages of a formatted text."""
    out, at = [], 0
    while at < len(formatted):
        head = _TURN.match(formatted, at)
        end = formatted.index(CLOSE, head.end())
        out.append((_role_in(head[1]), unescaped(formatted[head.end() : end])))
        at = end + len(CLOSE)
    return out


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[tuple]]]:
    now, log, begun = None, [], False
    for batch in batches:
        columns = [batch[c].to_pylist() for c in ("conv_id", "seq", "kind", "target", "role", "text")]
        for conv, *event in zip(*columns, strict=True):
            if begun and conv != now:
                yield now, log
                log = []
            now, begun = conv, True
            log.append(tuple(event))
    if begun:
        yield now, log


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, texts, masks, size = [], [], [], 0

    def flush():
        spans = pa.array(masks, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string()), spans], ["conv_id", "formatted", "loss_spans"])

    for conv, log in _conversations(batches):
        formatted, spans = render(fold(log))
        ids.append(conv)
        texts.append(formatted)
        masks.append([{"start": a, "end": b} for a, b in spans])
        size += len(formatted)
        if size > 1 << 22:
            yield flush()
            ids, texts, masks, size = [], [], [], 0
    if ids:
        yield flush()


def format_conversations(events: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans of every conversation in a log with the columns of EVENTS."""
    log = events.select("conv_id", "seq", "kind", "target", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "seq", "role", "text")
    return log.mapInArrow(_format, "conv_id long, formatted string, loss_spans array<struct<start:bigint,end:bigint>>")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of what parsing the formatted texts gives back."""
    for batch in batches:
        rows = []
        for conv, formatted, spans in zip(*(batch[c].to_pylist() for c in ("conv_id", "formatted", "loss_spans")), strict=True):
            turns, loss, chars = hashlib.sha256(), hashlib.sha256(), 0
            messages = parse(formatted)
            for role, text in messages:
                turns.update(f"{role}\n{text}\n".encode())
            for span in spans:
                text = unescaped(formatted[span["start"] : span["end"]])
                loss.update(text.encode())
                chars += len(text)
            rows.append((conv, len(messages), turns.hexdigest(), chars, loss.hexdigest(), len(formatted)))
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)], names)


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long").alias("seq"), "role", "text")
    planted = spark.createDataFrame([(-1, 0, "user", PLANTED), (-1, 1, LEARNED, PLANTED)], "conv_id long, seq long, role string, text string")
    events = rows.unionByName(planted).select("conv_id", "seq", F.lit("message").alias("kind"), F.lit(None).cast("long").alias("target"), "role", "text")
    return format_conversations(events).mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


_PAT = r"([<\[])(\\*)(\||/?s>|/?INST\]|</?SYS>>)"
OP8_SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PLANTED}' UNION ALL SELECT -1, 1, 'assistant', '{PLANTED}')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(sum({len(OPEN) + len(CLOSE) + 1} + length(regexp_replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '{_PAT}', '\1\\\2\3', 'g'))
    + length(regexp_replace(text, '{_PAT}', '\1\\\2\3', 'g'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
