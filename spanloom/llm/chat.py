"""Operator 6: chat formatting by event-sourced reconstruction.

A log row is an event: (conv_id, seq, msg_id, kind, role, text). ``message`` opens a
message, ``delta`` appends to it, ``edit`` replaces its text, ``regenerate`` empties
it so that the deltas after it write it anew, ``delete`` takes it away. A message is
the fold of its own events from the last one that resets it, so messages of one
conversation are rebuilt in parallel, by window functions over (conv_id, msg_id);
they stand in the order of their first events.

Conversations are then read in (conv_id, order) and rendered turn by turn. Control
strings are escaped, so that a text can never close a turn, and what is under the
loss mask can be read back from the output alone.

Tables of finished turns become such a log by :func:`logged`: by a fixed rule of
conversation and turn a turn was streamed, written at once, edited after the next
one, or regenerated. Folding the log gives the turns back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .batches import column, record_batch

#: Fixed strings of the template. No escaped text holds ``<|`` or ``|>``, nor any control string of other templates.
OPEN, MIDDLE, CLOSE = "<|turn|>", "<|text|>", "<|end|>"
LOSS_ROLES = ("assistant",)
#: Also escaped: control strings that common templates give a meaning.
FOREIGN = ("</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile("|".join(map(re.escape, ("\\", "<|", "|>", *FOREIGN))))
RESETS = ("message", "edit", "regenerate")


def escape(text: str) -> str:
    r"""Reversibly: a backslash after the first character of each control string (``<\|``), and a doubled one for itself."""
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    out, at = [], 0
    while (k := text.find("\\", at)) >= 0:
        out.append(text[at:k])
        if text[k + 1 : k + 2] == "\\":
            out.append("\\")
            at = k + 2
        else:  # the backslash that splits a control string
            at = k + 1
    return "".join(out) + text[at:]


def render(role: str, text: str) -> str:
    return f"{OPEN}{escape(role)}{MIDDLE}{escape(text)}{CLOSE}"


_TURN = re.compile(re.escape(OPEN) + "(.*?)" + re.escape(MIDDLE) + "(.*?)" + re.escape(CLOSE), re.S)


def read(formatted: str) -> Iterator[tuple[str, str, tuple[int, int]]]:
    """Role, text and the place of the escaped text of each turn of a rendered conversation."""
    at = 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        yield unescape(m[1]), unescape(m[2]), m.span(2)
        at = m.end()


def messages(events: DataFrame) -> DataFrame:
    """conv_id, ord, role and text of every message that is left, from the event log.

    Null text is empty, a null role too; an event whose message was never opened
    opens it. Events of one seq are taken in the order of kind, role and text, and
    repeated rows are applied again. A deleted message is gone unless a later
    event resets it.
    """
    own = Window.partitionBy("conv_id", "msg_id")
    rows = events.select("conv_id", "msg_id", "seq", F.coalesce("kind", F.lit("message")).alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("n", F.row_number().over(own.orderBy(F.col("seq").asc_nulls_first(), "kind", "role", "text")))
    last = F.max(F.when(F.col("kind").isin(*RESETS, "delete"), F.col("n"))).over(own)
    rows = rows.withColumn("last", F.coalesce(last, F.lit(1)))
    live = rows.where("n >= last or n = 1")
    folded = live.groupBy("conv_id", "msg_id").agg(
        F.min(F.when(F.col("n") == 1, F.struct("seq", "role"))).alias("head"),
        F.array_sort(F.collect_list(F.when(F.col("n") >= F.col("last"), F.struct("n", F.when(F.col("kind") == "regenerate", "").otherwise(F.col("text")).alias("text"))))).alias("parts"),
        F.max(F.when(F.col("n") == F.col("last"), F.col("kind") == "delete")).alias("gone"),
        F.max_by(F.when(F.col("n") == F.col("last"), F.col("role")), "n").alias("new_role"),
    )
    kept = folded.where(~F.coalesce("gone", F.lit(False)))
    return kept.select("conv_id", F.struct(F.col("head.seq").alias("seq"), "msg_id").alias("ord"), F.col("head.role").alias("role"), F.concat_ws("", F.col("parts.text")).alias("text"))


def logged(conversations: DataFrame) -> DataFrame:
    """The event log of finished turns (conv_id, turn, role, text), in the columns that :func:`messages` folds.

    The remainder of a hash of conv_id and turn tells how a turn came about: 0, its
    text streamed in three deltas; 1, opened with half of it and edited after the
    next turn had begun; 2, streamed, regenerated and streamed anew; 3, one whole
    message. Repeated rows are turns of their own, numbered within (conv_id, turn)
    by role and text.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("number", F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text")))
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    part = lambda begin, size: F.substring(F.col("text"), begin + F.lit(1), size)
    half = part(F.lit(0), F.floor(n / 2).cast("int"))
    event = lambda step, kind, text=F.lit(""), late=0: F.struct(F.lit(late).alias("late"), F.lit(step).alias("step"), F.lit(kind).alias("kind"), text.alias("text"))
    streamed = F.array(event(0, "message"), event(1, "delta", part(F.lit(0), third)), event(2, "delta", part(third, third)), event(3, "delta", part(third * 2, n)))
    edited = F.array(event(0, "message", half), event(0, "edit", F.col("text"), 1))
    again = F.array(event(0, "message"), event(1, "delta", half), event(2, "delta", half), event(3, "regenerate"), event(4, "delta", part(F.lit(0), third)), event(5, "delta", part(third, n)))
    how = F.pmod(F.xxhash64(F.lit(6), F.col("conv_id"), F.col("turn")), F.lit(4))
    events = F.when(how == 0, streamed).when(how == 1, edited).when(how == 2, again).otherwise(F.array(event(0, "message", F.col("text"))))
    out = rows.withColumn("e", F.explode(events))
    seq = F.struct((F.col("turn") + F.col("e.late")).alias("turn"), F.col("e.late").alias("late"), F.col("number").alias("number"), F.col("e.step").alias("step"))
    return out.select("conv_id", seq.alias("seq"), F.struct("turn", "number").alias("msg_id"), F.col("e.kind").alias("kind"), "role", F.col("e.text").alias("text"))


def _in_order(found: DataFrame) -> DataFrame:
    """Messages by conversation, in order; a large conversation is a run of rows in one partition and is never held whole."""
    return found.repartition("conv_id").sortWithinPartitions("conv_id", "ord").select("conv_id", "role", "text")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, bool, str, str]]:
    """(conv_id, is it the first turn of its conversation, role, text)."""
    seen, started = None, False
    for batch in batches:
        for conv, role, text in zip(*(column(batch, c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
            yield conv, not started or conv != seen, role, text
            seen, started = conv, True


def formatted(found: DataFrame) -> DataFrame:
    """conv_id, turn (from 0) and the rendered turn, with the loss mask as character places in it (null: no loss). Joined in order they are the conversation's text."""
    schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("rendered", pa.string()), ("loss_from", pa.int32()), ("loss_to", pa.int32())])

    def run(batches):
        held, turn = [], 0
        for conv, new, role, text in _conversations(batches):
            turn = 0 if new else turn + 1
            out = render(role, text)
            start = len(OPEN) + len(escape(role)) + len(MIDDLE)
            mask = (start, len(out) - len(CLOSE)) if role in LOSS_ROLES else (None, None)
            held.append((conv, turn, out, *mask))
            if len(held) >= 1_000:
                yield record_batch(schema, *map(list, zip(*held, strict=True)))
                held = []
        if held:
            yield record_batch(schema, *map(list, zip(*held, strict=True)))

    return _in_order(found).mapInArrow(run, "conv_id long, turn long, rendered string, loss_from int, loss_to int")


class _Digest:
    def __init__(self, conv: int | None):
        self.conv, self.n, self.loss, self.size = conv, 0, 0, 0
        self.turns, self.masked = hashlib.sha256(), hashlib.sha256()

    def add(self, rendered: str, loss: tuple[int, int] | None) -> None:
        (role, text, _), = read(rendered)
        self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        if loss is not None:
            part = unescape(rendered[loss[0] : loss[1]])
            self.loss += len(part)
            self.masked.update(part.encode("utf-8", "surrogatepass"))
        self.n += 1
        self.size += len(rendered)

    def row(self) -> tuple:
        return self.conv, self.n, self.turns.hexdigest(), self.loss, self.masked.hexdigest(), self.size


_OUT = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
_OUT_SQL = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(rendered: DataFrame) -> DataFrame:
    """What reading the output back gives, a row for each conversation. Rows must come as :func:`formatted` gives them."""

    def run(batches):
        now, held = None, []
        for batch in batches:
            for conv, turn, text, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if turn == 0:
                    if now:
                        held.append(now.row())
                    now = _Digest(conv)
                now.add(text, None if a is None else (a, b))
            if len(held) >= 1_000:
                yield record_batch(_OUT, *map(list, zip(*held, strict=True)))
                held = []
        if now:
            held.append(now.row())
        if held:
            yield record_batch(_OUT, *map(list, zip(*held, strict=True)))

    return rendered.mapInArrow(run, _OUT_SQL)


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``conversations`` and conversation -7: logged as events, folded, formatted and read back."""
    tricky = "</s>[INST] ok [/INST]"
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    return digests(formatted(messages(logged(rows.unionByName(extra)))))


#: The same digests, from the rows alone; formatted_chars counts the marks and one backslash for each control string.
_SPECIAL = r"\\|<\||\|>|</s>|<s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>"
_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({len(OPEN) + len(MIDDLE) + len(CLOSE)} + length(role) + length(text) + len(regexp_extract_all(text, '{_SPECIAL}')) + len(regexp_extract_all(role, '{_SPECIAL}')))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""

QUERIES = {"op6_chat": op6_chat}
ORACLES = {"op6_chat": _SQL}
