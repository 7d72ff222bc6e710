"""Chat formatting in budgeted windows.

Method: every turn's tokens are counted and prefix-summed along its conversation (range-partitioned rows with carries
between partitions, so one huge conversation is summed by many tasks). A turn belongs to the span its prefix falls in; one
that is long and crosses the span's end is a window of its own, so windows are turn-aligned and within the budget. The
conversation's system turn and the last turns of the window before are repeated where the budget allows; the loss mask
covers each assistant text once, in the window it belongs to. Control strings inside texts and roles are broken up reversibly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voucherlens.llm.common import written
from voucherlens.llm.packing import _encoder

# The strings this template and others use as controls.
CONTROLS = ["<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str, line: bool = False) -> str:
    """`text` without a control string in it: a backslash doubled, controls broken by "\\." after their first character; line: no newline either."""
    out = _CONTROL.sub(lambda m: m[0][0] + "\\." + m[0][1:], text.replace("\\", "\\\\"))
    return out.replace("\n", "\\n") if line else out


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: {".": "", "n": "\n"}.get(m[1], m[1]), text)


def turn_text(role: str | None, text: str | None) -> tuple[str, int, int]:
    """A formatted turn, and where its escaped text begins and ends in it. Null role or text: empty."""
    head, body = f"<|im_start|>{escape(role or '', True)}\n", escape(text or "")
    return f"{head}{body}<|im_end|>\n", len(head), len(head) + len(body)


def _prefixed(turns: DataFrame, encoder: tuple) -> DataFrame:
    """(conv_id, turn, role, text, before, tokens): tokens of the conversation before each turn."""
    keys = ["conv_id", "turn", "role", F.xxhash64("text")]
    rows = turns.repartitionByRange(*keys).sortWithinPartitions(*keys, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, last, before = _encoder(*encoder), TaskContext.get().partitionId(), object(), 0
        for batch in batches:
            n, starts = [], []
            for conv, role, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                before = before if conv == last else 0
                last = conv
                n.append(len(encode(turn_text(role, text)[0])))
                starts.append(before)
                before += n[-1]
            yield pa.record_batch([*batch.columns, pa.array([part] * len(n), pa.int32()), pa.array(starts, pa.int64()), pa.array(n, pa.int64())], names=["conv_id", "turn", "role", "text", "part", "before", "tokens"])

    rows = written(rows.mapInArrow(run, "conv_id long, turn long, role string, text string, part int, before long, tokens long"), "turns")
    sums = rows.groupBy("conv_id", "part").agg(F.sum("tokens").alias("sum"))
    wide = sums.groupBy("conv_id").agg(F.count(F.lit(1)).alias("parts")).where("parts > 1").select(F.col("conv_id").alias("wide"))
    # conversations that cross a partition's edge: a row for each partition of each, two conversations a partition at most
    carried = sums.join(F.broadcast(wide), F.col("conv_id").eqNullSafe(F.col("wide")), "left_semi")
    carried = carried.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), (F.sum("sum").over(Window.partitionBy("conv_id").orderBy("part")) - F.col("sum")).alias("carry"))
    rows = rows.join(F.broadcast(carried), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")), "left")
    return rows.select("conv_id", "turn", "role", "text", (F.col("before") + F.coalesce("carry", F.lit(0))).alias("before"), "tokens")


def format_conversations(turns: DataFrame, json_path: str, ranks_path: str | None = None, pattern: str | None = None, budget: int = 2048, history: int = 256) -> DataFrame:
    """(conv_id, window, text, new_from, loss, tokens): one row per window.

    `turns` has conv_id, turn, role, text (further columns are ignored). `loss` lists the (start, stop) characters of
    assistant texts that are trained on; text before `new_from` repeats the system turn and history. Turns of one number
    follow by role and text. Null texts are empty turns; rows of a null conv_id make one conversation. No window exceeds
    the budget, but for one that holds a single longer turn; a quarter of the budget is left free for the system turn, and
    the system turn, then the history, are left out where they don't fit.
    """
    if not 0 <= history <= budget // 2:
        raise ValueError("history must be half the budget at most")
    room = max(1, budget - budget // 4 - history)
    long = room // 4
    span = max(1, room - long)
    turns = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    rows = written(_prefixed(turns, (json_path, ranks_path, pattern)), "prefixed").withColumn("c", F.struct("conv_id"))
    at, end = F.floor(F.col("before") / span).cast("long"), F.col("before") + F.col("tokens")
    alone = (end > (at + 1) * span) & (F.col("tokens") > long)
    turn = F.struct("before", "role", "text", "tokens").alias("t")
    own = rows.groupBy("c", at.alias("at"), alone.alias("alone")).agg(F.sort_array(F.collect_list(turn)).alias("ts"))  # a budget of turns each
    # turns follow without a gap: where one window ends, the next begins
    last = F.element_at("ts", -1)
    own = own.select("c", F.get("ts", F.lit(0))["before"].alias("start"), (last["before"] + last["tokens"]).alias("end"), "ts")
    tails = own.select("c", F.col("end").alias("start"), F.filter("ts", lambda t: t["before"] >= F.col("end") - history).alias("again")).where(F.size("again") > 0)
    system = rows.where((F.col("before") == 0) & (F.col("role") == "system") & (F.col("tokens") <= budget)).groupBy("c").agg(F.min(turn).alias("system"))
    groups = own.join(tails, ["c", "start"], "left").join(system, "c", "left").select("c.conv_id", F.col("start").alias("window"), "ts", F.when(F.col("start") > 0, F.col("system")).alias("system"), "again")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, news, losses, sizes = [], [], [], []
            for ts, first, again in zip(*[batch.column(i).to_pylist() for i in (2, 3, 4)], strict=True):
                left = budget - sum(t["tokens"] for t in ts)
                head, tail = [], []
                if first and first["tokens"] <= left:
                    head.append(first)
                    left -= first["tokens"]
                for t in reversed(again or []):
                    if t["tokens"] > left or (t["before"] == 0 and first):
                        break
                    tail.insert(0, t)
                    left -= t["tokens"]
                text, at, loss, new, tokens = [], 0, [], 0, 0
                for t, is_new in [(t, False) for t in head + tail] + [(t, True) for t in ts]:
                    one, a, b = turn_text(t["role"], t["text"])
                    if is_new and t["role"] == "assistant":
                        loss.append({"start": at + a, "stop": at + b})
                    text.append(one)
                    at += len(one)
                    new += 0 if is_new else len(one)
                    tokens += t["tokens"]
                texts.append("".join(text))
                news.append(new)
                losses.append(loss)
                sizes.append(tokens)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(news, pa.int64()), pa.array(losses, kind), pa.array(sizes, pa.int64())], names=["conv_id", "window", "text", "new_from", "loss", "tokens"])

    return groups.mapInArrow(run, "conv_id long, window long, text string, new_from long, loss array<struct<start:long,stop:long>>, tokens long")


def read_turns(text: str, new_from: int = 0) -> list[tuple[str, str]]:
    """(role, text) of the turns a window adds, unescaped."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(text, new_from)]


def digests(windows: DataFrame) -> DataFrame:
    """Per conversation, read back from its windows: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    A digest is a running hash, so windows stream through in order and no conversation is ever held whole.
    """
    rows = windows.select("conv_id", "window", "text", "new_from", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "window")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, ready = None, []
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

        def close() -> None:
            if own is not None:
                ready.append((own[0], own[1], own[2].hexdigest(), own[3], own[4].hexdigest(), own[5]))

        for batch in batches:
            for row in batch.to_pylist():
                if own is None or own[0] != row["conv_id"]:
                    close()
                    own = [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in read_turns(row["text"], row["new_from"]):
                    own[1] += 1
                    own[2].update(f"{role}\n{text}\n".encode())
                for span in row["loss"]:
                    said = unescape(row["text"][span["start"] : span["stop"]])
                    own[3] += len(said)
                    own[4].update(said.encode())
                own[5] += len(row["text"])
            if ready:
                yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*ready, strict=True), kinds, strict=True)], names=names)
                ready.clear()
        close()
        if ready:

            yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*ready, strict=True), kinds, strict=True)], names=names)

    return rows.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
