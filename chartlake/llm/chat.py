"""Chat formatting with loss masks that are aligned to token offsets.

A turn becomes OPEN role MIDDLE text CLOSE. The three control strings are single
tokens of the encoder, and in roles and texts they (and every other special token of
it) are escaped, so a conversation can be read back from its formatted text and no
token spans a control string. A conversation is rendered whole and encoded once with
offsets; the sorted spans of the assistant's texts are intersected with the sorted
token spans by binary search.

A very long conversation is rendered in segments of whole turns. Since tokens end at
control strings, its token ids and mask are those of the whole. Rows are range-split
by (conversation, turn), so one conversation with very many turns is spread over
tasks, and a task holds one segment at a time.

Defined results: null role or text counts as empty; turns go by number (null first),
then role and text, and repeated rows are turns of their own; a null conversation id
is a conversation of its own; an empty table gives no rows; other columns are dropped.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartlake.llm import textkernels as tk

#: Characters after which a segment of a conversation ends.
SEGMENT_CHARS = 1 << 20
LEARNED_ROLE = "assistant"


@dataclass(frozen=True)
class Template:
    open: str = "[INST]"
    middle: str = "[/INST]"
    close: str = "</s>"
    others: tuple[str, ...] = ("<|endoftext|>",)

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.open, self.middle, self.close, *self.others)

    def escape(self, text: str) -> str:
        """Double backslashes, and put one behind the first character of control strings."""
        text = text.replace("\\", "\\\\")
        return re.sub("|".join(map(re.escape, self.controls)), lambda m: m[0][0] + "\\" + m[0][1:], text)

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)

    def render(self, turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
        """The formatted text and the spans of the learned texts in it."""
        out, at, spans = [], 0, []
        for role, text in turns:
            head = f"{self.open}{self.escape(role)}{self.middle}"
            body = self.escape(text)
            if role == LEARNED_ROLE:
                spans.append((at + len(head), at + len(head) + len(body)))
            out += [head, body, self.close]
            at += len(head) + len(body) + len(self.close)
        return "".join(out), spans

    def parse(self, formatted: str) -> list[tuple[str, str]]:
        """The turns, read back from a formatted text."""
        turns = []
        for turn in formatted.split(self.close)[:-1]:
            role, _, text = turn.removeprefix(self.open).partition(self.middle)
            turns.append((self.unescape(role), self.unescape(text)))
        return turns


def token_mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """True for tokens that lie in a span; tokens and spans are sorted."""
    change = np.zeros(len(starts) + 1, np.int64)
    some = np.array([s for s in spans if s[0] < s[1]], np.int64).reshape(-1, 2)
    np.add.at(change, np.searchsorted(ends, some[:, 0], side="right"), 1)
    np.add.at(change, np.searchsorted(starts, some[:, 1], side="left"), -1)
    return np.cumsum(change[:-1]) > 0


def masked_spans(starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> list[tuple[int, int]]:
    """Character spans of the runs of masked tokens."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return [(int(starts[a]), int(ends[b - 1])) for a, b in zip(edge[::2], edge[1::2])]


def encoder(definition: str, template: Template):
    from tokenizers import AddedToken, Tokenizer

    tokenizer = Tokenizer.from_str(definition)
    tokenizer.add_special_tokens([AddedToken(c, normalized=False, special=True) for c in template.controls])
    return tokenizer


def format_conversations(
    rows: DataFrame, tokenizer_path: str, template: Template = Template(), segment_chars: int = SEGMENT_CHARS
) -> DataFrame:
    """Segments in order of ``part``, ``seq``: ``conv_id``, ``formatted``, ``input_ids``,
    ``loss_mask`` (one entry a token) and ``loss_spans`` (characters of masked tokens).

    ``rows`` has conv_id, turn, role, text.
    """
    spark = rows.sparkSession
    tk.arrow_batches(spark)
    with open(tokenizer_path, encoding="utf-8") as file:
        definition = spark.sparkContext.broadcast(file.read())
    parts = astuple(template)
    order = ["conv_id", "turn", "role", "text"]

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape, part = Template(*parts), TaskContext.get().partitionId()
        tokenizer = encoder(definition.value, shape)
        ready: list[tuple] = []
        turns: list[tuple[str, str]] = []
        seq, waiting = 0, 0  # segments so far, characters in ``ready``
        last, size = None, 0

        def close() -> None:
            nonlocal waiting
            if turns:
                ready.append((last[0], *shape.render(turns)))
                waiting += len(ready[-1][1])
                turns.clear()

        def flush() -> pa.RecordBatch:
            nonlocal seq, waiting
            coded = tokenizer.encode_batch([r[1] for r in ready], add_special_tokens=False)
            columns: list[list] = [[], [], [], [], [], [], []]
            for (conv, formatted, spans), code in zip(ready, coded):
                offsets = np.array(code.offsets, np.int64).reshape(-1, 2)
                mask = token_mask(offsets[:, 0], offsets[:, 1], spans)
                found = masked_spans(offsets[:, 0], offsets[:, 1], mask)
                row = (part, seq, conv, formatted, code.ids, mask, [{"start": a, "end": b} for a, b in found])
                for column, value in zip(columns, row):
                    column.append(value)
                seq += 1
            ready.clear()
            waiting = 0
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.bool_()),
                     pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            names = ["part", "seq", "conv_id", "formatted", "input_ids", "loss_mask", "loss_spans"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        for batch in batches:
            for piece in tk.slices(batch, "text"):
                values = [piece.column(c).to_pylist() for c in ("conv_id", "role", "text")]
                for conv, role, text in zip(*values):
                    if last is not None and (last[0] != conv or size >= segment_chars):
                        close()
                        size = 0
                    last = (conv,)
                    turns.append((role or "", text or ""))
                    size += len(turns[-1][1]) + 1
                if waiting > segment_chars:
                    yield flush()
        close()
        if ready:
            yield flush()

    dealt = rows.select(*order).repartitionByRange(*[F.col(c).asc_nulls_first() for c in order[:3]])
    return dealt.sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order]).mapInArrow(
        render,
        "part int, seq long, conv_id long, formatted string, input_ids array<int>, loss_mask array<boolean>, "
        "loss_spans array<struct<start:long,end:long>>",
    )


def digests(segments: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per conversation, read back from its segments, which a task takes one at a time."""
    parts = astuple(template)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = Template(*parts)
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "loss_tokens"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        key, turns, loss, count, done = None, None, None, [0] * 5, []

        def finish() -> None:
            if key is not None:
                done.append((key[0], count[0], turns.hexdigest(), count[1], loss.hexdigest(), *count[2:]))

        for batch in batches:
            rows = [batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_spans", "tokens", "masked")]
            for conv, formatted, spans, tokens, masked in zip(*rows):
                if key != (conv,):
                    finish()
                    key, turns, loss, count = (conv,), hashlib.sha256(), hashlib.sha256(), [0] * 5
                for role, text in shape.parse(formatted):
                    turns.update(f"{role}\n{text}\n".encode())
                    count[0] += 1
                for span in spans:
                    learned = shape.unescape(formatted[span["start"] : span["end"]])
                    loss.update(learned.encode())
                    count[1] += len(learned)
                count[2] += len(formatted)
                count[3] += tokens
                count[4] += masked
            if len(done) > 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names)
                done.clear()
        finish()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names)

    masked = F.aggregate("loss_mask", F.lit(0), lambda n, m: n + m.cast("int"))
    narrow = segments.select(
        "conv_id", "part", "seq", "formatted", "loss_spans", F.size("input_ids").cast("long").alias("tokens"),
        masked.cast("long").alias("masked"),
    )
    dealt = narrow.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    return dealt.mapInArrow(
        read,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
        "n_tokens long, loss_tokens long",
    )
