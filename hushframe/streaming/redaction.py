"""Redaction and detection over ordered chunk streams.

A stream is a sequence of chunks (stream_id, chunk_seq, data, is_eof). The state of a stream is the raw text not yet sent on, the chunks that
came before their turn, and counters. What no later text can change is sent: everything but the last ``look_ahead`` characters, or less where
a match reaches into them, or where one that is open may still be completed or lengthened (a block without its END marker, a JWT, a token, a URI). So
the result is that of the whole text, wherever chunks are cut. Only URIs and tokens without a maximum can be open without end: one that is longer than
``HOLD`` characters is redacted as far as it has come, and everything that belongs to it is an x from then on, so nothing of it goes out in clear. A
match is counted once, with its place in the whole stream. The end of the stream sends the rest."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from ..functions import kernel
from ..sources.catalog import DEFAULT_TABLE, Validated, validated

LOOK_AHEAD = 512
#: Characters that an open match may hold back; more than any pattern with a maximum needs.
HOLD = 32_768
#: Characters of a stream in a table that are fed at once.
TOGETHER = 65_536
COUNTERS = ("bytes_read", "bytes_written", "chunks_processed", "patterns_found")
OUT = "stream_id long, out_seq long, redacted string, bytes_read long, bytes_written long, chunks_processed long, patterns_found long, done boolean"
MATCHES = "stream_id long, pattern_type int, detector string, start long, `end` long"
STATE = "state string"


def _size(text: str) -> int:
    return len(text.encode("utf-8", "surrogatepass"))


class Stream:
    """One stream: feed chunks in order, finish at the end. ``found`` has the matches (start, end, type, detector) that were sent since it was last
    emptied, placed in the whole stream."""

    def __init__(self, look_ahead: int = LOOK_AHEAD, rows: tuple[Validated, ...] | None = None, hold: int = HOLD) -> None:
        self.look_ahead, self.hold = look_ahead, hold
        self.rows = validated() if rows is None else rows
        self.held, self.sent = "", 0
        #: An open match that is already being redacted: its start, type, detector, and the pattern of its characters.
        self.run: list | None = None
        self.stats = dict.fromkeys(COUNTERS, 0)
        self.found: list[tuple[int, int, int, str]] = []

    def _out(self, text: str) -> str:
        self.stats["bytes_written"] += _size(text)
        return text

    def _send(self, upto: int, found: list[kernel.Match]) -> str:
        out = kernel.redact(self.held[:upto], found)
        self.stats["patterns_found"] += len(found)
        self.found += [(self.sent + s, self.sent + e, kind, which) for s, e, kind, which, _ in found]
        self.held, self.sent = self.held[upto:], self.sent + upto
        return self._out(out)

    def _go_on(self, last: bool = False) -> str:
        """The characters of the open match that have come; it ends at the first other one."""
        start, kind, which, pattern = self.run
        n = re.compile(pattern).match(self.held).end()
        if n < len(self.held) or last:
            self.found.append((start, self.sent + n, kind, which))
            self.run = None
        out = "x" * _size(self.held[:n])
        self.held, self.sent = self.held[n:], self.sent + n
        return self._out(out)

    def _boundary(self, raw: list[kernel.Match]) -> int:
        """Up to where nothing that comes can change what is found: outside what any detector found by itself, every prefix hit and open match, and
        not just behind a block, as a block that begins there is passed over."""
        upto = min(len(self.held) - self.look_ahead, kernel.open_from(self.held, self.rows))
        spans = [(start, end + (which == "marker")) for start, end, _, which, _ in raw] + kernel.hits(self.held, self.rows)
        for start, end in sorted(spans, reverse=True):
            if start < upto < end:
                upto = start
        return upto

    def feed(self, data: str, chunks: int = 1) -> str:
        self.stats["bytes_read"] += _size(data)
        self.stats["chunks_processed"] += chunks
        self.held += data
        out = self._go_on() if self.run else ""
        if len(self.held) <= self.look_ahead:
            return out
        raw = kernel.raw(self.held, self.rows)
        upto, found = self._boundary(raw), kernel.without_overlaps(raw)
        if len(self.held) - upto > self.hold + self.look_ahead:
            # only a match without a maximum blocks that long: it is sent whole, or as far as it has come
            block = next((m for m in found if m[0] >= upto), None)
            if block is not None and block[1] == len(self.held):
                out += self._send(block[0], [m for m in found if m[1] <= block[0]])
                part = self.held
                self.run = [self.sent, block[2], block[3], kernel.run_pattern(block, self.rows)]
                self.stats["patterns_found"] += 1
                self.held, self.sent = "", self.sent + len(part)
                return out + self._out(kernel.redact_match(part, block[2]))
            if block is not None:
                upto = block[1]
        return out + (self._send(upto, [m for m in found if m[1] <= upto]) if upto > 0 else "")

    def finish(self) -> str:
        out = self._go_on(last=True) if self.run else ""
        return out + self._send(len(self.held), kernel.detect(self.held, self.rows))

    def save(self) -> dict:
        return {"held": self.held, "sent": self.sent, "run": self.run, "stats": self.stats}

    def load(self, saved: dict) -> None:
        self.held, self.sent, self.run, self.stats = (saved[k] for k in ("held", "sent", "run", "stats"))


class Substitution:
    """One stream in which known strings are replaced (placeholders by secrets, or back), also where chunks cut them. ``used`` counts by string."""

    def __init__(self, pairs: dict[str, str]) -> None:
        self.pairs = {k: v for k, v in pairs.items() if k}
        self.pattern = re.compile("|".join(re.escape(k) for k in sorted(self.pairs, key=lambda k: (-len(k), k))) or r"(?!)")
        self.keep = max(map(len, self.pairs), default=1) - 1
        self.held, self.used = "", dict.fromkeys(self.pairs, 0)
        self.stats = dict.fromkeys(COUNTERS, 0)

    def _send(self, upto: int) -> str:
        out, at = [], 0
        for m in self.pattern.finditer(self.held):
            if m.start() >= upto:
                break
            out += [self.held[at : m.start()], self.pairs[m[0]]]
            at = m.end()
            self.used[m[0]] += 1
            self.stats["patterns_found"] += 1
        upto = max(upto, at)  # a string that begins before the boundary is whole
        out.append(self.held[at:upto])
        self.held = self.held[upto:]
        text = "".join(out)
        self.stats["bytes_written"] += _size(text)
        return text

    def feed(self, data: str, chunks: int = 1) -> str:
        self.stats["bytes_read"] += _size(data)
        self.stats["chunks_processed"] += chunks
        self.held += data
        return self._send(max(0, len(self.held) - self.keep))

    def finish(self) -> str:
        return self._send(len(self.held))

    def save(self) -> dict:
        return {"held": self.held, "used": self.used, "stats": self.stats}

    def load(self, saved: dict) -> None:
        self.held, self.used, self.stats = (saved[k] for k in ("held", "used", "stats"))


def _stateful(chunks: DataFrame, make: Callable[[], Stream | Substitution], rows: Callable, schema: str) -> DataFrame:
    """A streaming table of chunks through one object a stream. ``rows``: what a step returns, from (stream id, object, step's number, text, done).

    Chunks may come in any order; one that was seen before is dropped, as is one that comes after its stream's end."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        saved = json.loads(state.get[0]) if state.exists else {"next": 0, "early": {}, "out": 0, "ended": False, "stream": None}
        stream = make()
        if saved["stream"]:
            stream.load(saved["stream"])
        for batch in batches:
            for seq, data, eof in zip(batch["chunk_seq"], batch["data"], batch["is_eof"], strict=True):
                if not saved["ended"] and seq >= saved["next"]:
                    saved["early"][str(int(seq))] = [data or "", bool(eof)]
        text, done = [], False
        while not done and (chunk := saved["early"].pop(str(saved["next"]), None)) is not None:
            saved["next"] += 1
            text.append(stream.feed(chunk[0]))
            if chunk[1]:
                text.append(stream.finish())
                done = True
        was_over = saved["ended"]
        if done:  # what stays of an ended stream is that it has ended
            saved.update(ended=True, early={}, stream=None)
        elif not was_over:
            saved["stream"] = stream.save()
        saved["out"] += not was_over
        state.update((json.dumps(saved),))
        if not was_over:
            yield rows(key[0], stream, saved["out"], "".join(text), done)

    return chunks.groupBy("stream_id").applyInPandasWithState(step, schema, STATE, "append", "NoTimeout")


def _texts(key: int, stream: Stream | Substitution, n: int, text: str, done: bool) -> pd.DataFrame:
    return pd.DataFrame({"stream_id": [key], "out_seq": [n], "redacted": [text], **{k: [v] for k, v in stream.stats.items()}, "done": [done]})


def _found(key: int, stream: Stream, n: int, text: str, done: bool) -> pd.DataFrame:
    return pd.DataFrame([(key, kind, which, start, end) for start, end, kind, which in stream.found], columns=["stream_id", "pattern_type", "detector", "start", "end"])


def redact_stream(chunks: DataFrame, look_ahead: int = LOOK_AHEAD, table: str = DEFAULT_TABLE) -> DataFrame:
    """A streaming table of chunks -> the redacted text sent on for each, with the stream's counters so far."""
    rows = validated(table)
    return _stateful(chunks, lambda: Stream(look_ahead, rows), _texts, OUT)


def detect_stream(chunks: DataFrame, look_ahead: int = LOOK_AHEAD, table: str = DEFAULT_TABLE) -> DataFrame:
    """A streaming table of chunks -> its matches, each once, as soon as no later chunk can change it, placed in the whole stream."""
    rows = validated(table)
    return _stateful(chunks, lambda: Stream(look_ahead, rows), _found, MATCHES)


def substitute_stream(chunks: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """A streaming table of chunks with known strings replaced: placeholders by secrets in requests, secrets by placeholders in responses."""
    return _stateful(chunks, lambda: Substitution(pairs), _texts, OUT)


def _by_stream(chunks: DataFrame, make: Callable[[], Stream | Substitution], add: Callable[[int, Stream | Substitution, list[str]], list[tuple]], schema: pa.Schema, spark_schema: str) -> DataFrame:
    """A table of whole streams through one object a stream; ``add`` gives a stream's rows. Chunks are dealt out by stream and sorted, on disk if need
    be; a task holds one stream at a time, whatever the number of streams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, stream, text, first, rows = None, None, [], True, []
        held: list[str] = []  # chunks that are fed together, so that what a stream holds is not looked through for each small one

        def feed() -> None:
            text.append(stream.feed("".join(held), len(held)))
            held.clear()

        def end() -> None:
            feed()
            text.append(stream.finish())
            rows.extend(add(now, stream, text))

        def send() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * len(schema)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            size = 0
            for key, data in zip(batch.column("stream_id").to_pylist(), batch.column("data").to_pylist(), strict=True):
                if first or key != now:
                    if stream is not None:
                        end()
                    now, stream, first, text, size = key, make(), False, [], 0
                held.append(data or "")
                size += len(held[-1])
                if size > TOGETHER:
                    feed()
                    size = 0
            yield send()
        if stream is not None:
            end()
        yield send()

    dealt = chunks.select(F.col("stream_id").cast("long").alias("stream_id"), "chunk_seq", "data").repartition("stream_id").sortWithinPartitions("stream_id", "chunk_seq")
    return dealt.mapInArrow(run, spark_schema)


def _whole(chunks: DataFrame, make: Callable[[], Stream | Substitution]) -> DataFrame:
    schema = pa.schema([("stream_id", pa.int64()), ("redacted", pa.string()), *[(c, pa.int64()) for c in COUNTERS], ("errors", pa.int64())])
    add = lambda key, stream, text: [(key, "".join(text), *stream.stats.values(), 0)]
    return _by_stream(chunks, make, add, schema, "stream_id long, redacted string, " + ", ".join(f"{c} long" for c in COUNTERS) + ", errors long")


def redact_chunks(chunks: DataFrame, look_ahead: int = LOOK_AHEAD, table: str = DEFAULT_TABLE) -> DataFrame:
    """(stream_id, redacted, counters) of whole streams in a table of chunks."""
    rows = validated(table)
    return _whole(chunks, lambda: Stream(look_ahead, rows))


def detect_chunks(chunks: DataFrame, look_ahead: int = LOOK_AHEAD, table: str = DEFAULT_TABLE) -> DataFrame:
    """(stream_id, pattern_type, detector, start, end) of every match of the streams in a table of chunks."""
    rows = validated(table)
    schema = pa.schema([("stream_id", pa.int64()), ("pattern_type", pa.int32()), ("detector", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    add = lambda key, stream, text: [(key, kind, which, start, end) for start, end, kind, which in stream.found]
    return _by_stream(chunks, lambda: Stream(look_ahead, rows), add, schema, MATCHES)


def substitute_chunks(chunks: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """(stream_id, redacted, counters) of whole streams with known strings replaced; ``patterns_found`` counts the replacements."""
    return _whole(chunks, lambda: Substitution(pairs))


def redact_buffer(text: str, chunk_size: int = 65_536, look_ahead: int = LOOK_AHEAD, table: str = DEFAULT_TABLE) -> tuple[str, dict[str, int]]:
    """(redacted text, counters) of one text, fed in chunks."""
    stream = Stream(look_ahead, validated(table))
    out = [stream.feed(text[i : i + chunk_size]) for i in range(0, len(text), chunk_size)]
    return "".join([*out, stream.finish()]), stream.stats


def merge_stats(stats: DataFrame) -> DataFrame:
    """Counters of all streams."""
    return stats.agg(*[F.sum(c).alias(c) for c in COUNTERS])
