"""Chat formatting of event-sourced conversations.

A log has a row for each event: conversation, sequence, kind, message, role, text. Kinds:

* ``open``: a message begins with this role and text;
* ``delta``: the text is appended to what the message holds (streaming);
* ``edit``: the text replaces what the message holds;
* ``regenerate``: as edit, and every message of the conversation that was opened after this one, but before this event, is discarded.

``reconstruct`` partitions the log by conversation and message, sorts by sequence and folds each message's events into its final text, so that a task holds
one message at a time and a conversation may hold any share of the rows. What regenerations discard follows from their (opened, regenerated) spans
by a running maximum over the conversation's sequence, taken in two steps over ranges of it: within a range, and over ranges. ``render`` writes each message as one piece of its conversation's formatted
text, with the part that is under the loss mask; the pieces in order are the text. ``read_back`` parses the text again, conversation by conversation in sorted order.

Template: ``[INST] user [/INST]``, ``<s>assistant</s>``, ``[SYS]system[/SYS]`` and, for any other role, ``<|role|>name<|says|>text<|end|>``. A control string
inside a text or a name gets a backslash after its first character, one more if it has some already; reading takes one away. No control string begins inside another one, so a
text that is escaped holds none, and its end cannot form one with what follows.

Defined cases: a null text is empty, a null role is the empty name; an event of a message that was never opened opens it, and the first role that is not null counts; events of equal sequence
go as open, regenerate, edit, delta, then by text; unknown kinds are ignored; messages that open together stand by role, then formatted text; a null sequence stands first; a null conversation
is a conversation; repeated events count twice (a delta that was delivered twice is appended twice), repeated rows of a table of turns are turns of their own; very long texts are folded and escaped whole; bytes that are no
UTF-8 count as U+FFFD; an empty log gives no conversations; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, partitions, slices, small, text_of

# The markers of the template.
MARKERS = {"user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>"), "system": ("[SYS]", "[/SYS]")}
OTHER = ("<|role|>", "<|says|>", "<|end|>")
LEARNED = "assistant"

_CONTROL = r"(s>|/s>|INST\]|/INST\]|SYS\]|/SYS\]|\|role\|>|\|says\|>|\|end\|>)"
ESCAPE = r"([<\[])(\\*)" + _CONTROL
_ESCAPED = re.compile(r"([<\[])\\(\\*)" + _CONTROL)
_TURN = re.compile(r"\[INST\] (.*?) \[/INST\]|<s>(.*?)</s>|\[SYS\](.*?)\[/SYS\]|<\|role\|>(.*?)<\|says\|>(.*?)<\|end\|>", re.DOTALL)

KINDS = ("open", "regenerate", "edit", "delta")
_SEQ = "decimal(38,0)"
#: A null sequence, before all others.
_FIRST = Decimal(-(10**37))
#: Steps between two turns, and characters of a streamed delta, of a log that is made from turns.
_STEPS, _DELTA = 1 << 21, 512
_OUT_BYTES = 4 << 20


# ---------------------------------------------------------------- fold


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, message, seq, kind, role, text) sorted by message and sequence; one row (conv_id, opened, regenerated, role, text) for each message."""
    done: list[tuple] = []
    held = 0
    key = opened = again = role = None
    text: list[str] = []
    types = None

    def out() -> pa.RecordBatch:
        cols = zip(*done, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["conv_id", "opened", "regenerated", "role", "text"])

    for b in slices(batches):
        kinds = b.schema.types
        types = [kinds[0], kinds[2], kinds[2], pa.string(), pa.string()]
        for conv, message, seq, kind, who, said in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if (conv, message) != key:
                if key is not None:
                    done.append((key[0], opened, again, role or "", "".join(text)))
                    held += sum(map(len, text)) + 64
                    if held >= _OUT_BYTES:
                        yield out()
                        done, held = [], 0
                key, opened, again, role, text = (conv, message), seq, None, None, []
            if role is None:
                role = who
            if kind != 3:
                text = []
            if kind == 1:
                again = seq
            if said:
                text.append(said)
    if key is not None:
        done.append((key[0], opened, again, role or "", "".join(text)))
    if done:
        yield out()


def messages(log: DataFrame) -> DataFrame:
    """(conv_id, opened, regenerated, role, text): every message of the log in its last state, discarded ones too."""
    kind = F.coalesce(F.array_position(F.lit(list(KINDS)), F.col("kind")), F.lit(0)).cast("int") - 1
    events = log.select("conv_id", "message", F.coalesce(F.col("seq").cast(_SEQ), F.lit(_FIRST).cast(_SEQ)).alias("seq"), kind.alias("kind"), text_of("role").alias("role"), text_of("text").alias("text")).filter("kind >= 0")
    events = events.repartition("conv_id", "message").sortWithinPartitions("conv_id", "message", "seq", "kind", "text")
    return events.mapInArrow(_fold, f"conv_id {events.schema['conv_id'].dataType.simpleString()}, opened {_SEQ}, regenerated {_SEQ}, role string, text string")


def discarded(found: DataFrame) -> DataFrame:
    """(conv_id, opened) of messages that lie between an earlier message and its regeneration."""
    n = partitions(found.sparkSession)
    keys = found.select("conv_id", "opened", "regenerated").repartitionByRange(n, "conv_id", "opened").withColumn("part", F.spark_partition_id())
    points = materialize(keys.groupBy("part", "conv_id", "opened").agg(F.max("regenerated").alias("reach")))
    ahead = Window.unboundedPreceding, -1
    tops = points.groupBy("part", "conv_id").agg(F.max("reach").alias("top"))
    before = tops.select("part", "conv_id", F.max("top").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(*ahead)).alias("before")).filter("before is not null")
    inside = points.withColumn("inside", F.max("reach").over(Window.partitionBy("part", "conv_id").orderBy("opened").rowsBetween(*ahead)))
    met = inside.alias("i").join(small(materialize(before), 64).alias("b"), (F.col("i.part") == F.col("b.part")) & F.col("i.conv_id").eqNullSafe(F.col("b.conv_id")), "left")
    return met.filter(F.greatest("inside", "before") > F.col("opened")).select("i.conv_id", "opened")


def reconstruct(log: DataFrame) -> DataFrame:
    """(conv_id, opened, role, text): the final messages of every conversation, in the order of ``opened``."""
    return _without_discarded(materialize(messages(log)))


def _without_discarded(found: DataFrame) -> DataFrame:
    gone = small(materialize(discarded(found).withColumnsRenamed({"conv_id": "gone_conv", "opened": "gone_opened"})), 64)
    return found.join(gone, F.col("conv_id").eqNullSafe(F.col("gone_conv")) & (F.col("opened") == F.col("gone_opened")), "left_anti").drop("regenerated")


# ---------------------------------------------------------------- render


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(ESCAPE), F.lit(r"$1\\$2$3"))


def render(found: DataFrame) -> DataFrame:
    """Replaces the text by ``piece``, the message's part of the formatted conversation, and ``loss_from``, ``loss_to``: its code points under the loss mask (equal: none)."""
    body = escaped(F.col("text"))
    piece = F.concat(F.lit(OTHER[0]), escaped(F.col("role")), F.lit(OTHER[1]), body, F.lit(OTHER[2]))
    for role, (a, z) in MARKERS.items():
        piece = F.when(F.col("role") == role, F.concat(F.lit(a), body, F.lit(z))).otherwise(piece)
    a, z = MARKERS[LEARNED]
    shown = found.withColumn("piece", piece).withColumn("loss_from", F.lit(len(a)).cast("long"))
    end = F.when(F.col("role") == LEARNED, F.length("piece") - len(z)).otherwise(F.col("loss_from")).cast("long")
    return shown.withColumn("loss_to", end).drop("text")


def formatted(log: DataFrame) -> DataFrame:
    """(conv_id, opened, role, piece, loss_from, loss_to): the formatted conversations of a log, a piece for each final message. Written out."""
    return _without_discarded(materialize(render(messages(log))))


# ---------------------------------------------------------------- read


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text) if "\\" in text else text


def parse(formatted_text: str) -> list[tuple[str, str]]:
    """The (role, text) of each turn of a formatted conversation; anything between turns is an error."""
    turns, at = [], 0
    while at < len(formatted_text):
        m = _TURN.match(formatted_text, at)
        if not m:
            raise ValueError(f"no turn begins at {at}")
        user, assistant, system, role, other = m.groups()
        if other is not None:
            turns.append((unescaped(role), unescaped(other)))
        else:
            turns.append(next((r, unescaped(t)) for r, t in (("user", user), ("assistant", assistant), ("system", system)) if t is not None))
        at = m.end()
    return turns


_READ = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by conversation and place: a row for each conversation. Digests are fed turn by turn."""
    done: list[tuple] = []
    state = kind = None

    def close() -> tuple:
        conv, n, turns, chars, loss, size = state
        return conv, n, turns.hexdigest(), chars, loss.hexdigest(), size

    def out() -> pa.RecordBatch:
        types = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=_READ)

    for b in slices(batches, "piece"):
        kind = b.schema.types[0]
        for conv, piece, a, z in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if state is None or state[0] != conv:
                if state is not None:
                    done.append(close())
                    if len(done) >= 10_000:
                        yield out()
                        done = []
                state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text in parse(piece):
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
            learned = unescaped(piece[a:z])
            state[3] += len(learned)
            state[4].update(learned.encode())
            state[5] += len(piece)
    if state is not None:
        done.append(close())
    if done:
        yield out()


def read_back(pieces: DataFrame) -> DataFrame:
    """Per conversation: turns, a digest of their roles and texts, what is under the loss mask, and the formatted length.

    A digest runs through its conversation from first to last, so one task reads a conversation, sorted on disk, a few megabytes at a time.
    """
    d = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "opened", "role", "piece").select("conv_id", "piece", "loss_from", "loss_to")
    kind = d.schema["conv_id"].dataType.simpleString()
    return d.mapInArrow(_read, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


# ---------------------------------------------------------------- turns as a log


def log_of_turns(turns: DataFrame) -> DataFrame:
    """The log that would have led to a table of turns (conv_id, turn, role, text).

    Answers are streamed in deltas; by checksum, a quarter of them are a second try (a draft and a question that was asked after it were discarded by the regeneration) and a
    quarter of the other turns were edited once.
    """
    rows = turns.select(
        "conv_id",
        F.coalesce(F.col("turn").cast("decimal(28,0)"), F.lit(Decimal(-(10**27))).cast("decimal(28,0)")).alias("turn"),
        F.coalesce(text_of("role"), F.lit("")).alias("role"),
        F.coalesce(text_of("text"), F.lit("")).alias("text"),
    ).withColumn("message", F.monotonically_increasing_id())
    draw = F.crc32(F.concat_ws(":", "conv_id", "turn").cast("binary")) % 4

    def event(step: Column | int, kind: str, text: Column, role: Column | None = None, message: Column | None = None) -> Column:
        at = F.lit(step) if isinstance(step, int) else step
        who = F.lit(None).cast("string") if role is None else role
        return F.struct(at.cast("int").alias("step"), F.lit(kind).alias("kind"), (F.col("message") if message is None else message).alias("message"), who.alias("role"), text.alias("text"))

    nothing, role, text = F.lit(""), F.col("role"), F.col("text")
    streamed = F.transform(F.regexp_extract_all("text", F.lit(f"(?s)(.{{1,{_DELTA}}})"), F.lit(1)), lambda t, i: event(i + 4, "delta", t))
    second_try = F.array(event(1, "delta", F.concat(F.lit("No. "), F.substring("text", 1, 80))), event(2, "open", F.lit("Really?"), F.lit("user"), -F.col("message") - 1), event(3, "regenerate", nothing))
    answer = F.concat(F.array(event(0, "open", nothing, role)), F.when(draw == 0, second_try).otherwise(F.slice(second_try, F.lit(1), F.lit(0))), streamed)
    edited = F.array(event(0, "open", F.reverse("text"), role), event(1, "edit", text))
    other = F.when(draw == 1, edited).otherwise(F.array(event(0, "open", text, role)))
    each = rows.select("conv_id", "turn", F.explode(F.when(role == LEARNED, answer).otherwise(other)).alias("e"))
    return each.select("conv_id", (F.col("turn") * _STEPS + F.col("e.step")).cast(_SEQ).alias("seq"), "e.kind", "e.message", "e.role", "e.text")
