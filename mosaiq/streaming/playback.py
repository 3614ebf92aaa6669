"""Animation players as keyed state over a stream of ticks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.sequence import BACKWARD, BACKWARD_LOOP, FORWARD, FORWARD_LOOP

#: Sequences of an animation file, at most: their number has 16 bits.
MOST_SEQUENCES = 65536
STATE = "frame long, time long, direction int, playing boolean, reset boolean"
OUTPUT = "seq long, tick long, frame_no long, playing boolean"


class Player:
    """One sequence's player: ``durations`` a frame each, ``mode`` one of the four."""

    def __init__(self, durations: list[int], mode: int, start: int = 0, state: tuple | None = None):
        self.durations, self.mode, self.begin = durations, mode, start
        self.frame, self.time, self.direction, self.playing, self.reset = state or (start, 0, 1, False, True)

    @property
    def state(self) -> tuple:
        return self.frame, self.time, self.direction, self.playing, self.reset

    def play(self) -> None:
        """Go on; after a stop, from the first frame."""
        if self.reset:
            self.frame, self.time, self.direction = self.begin, 0, 1
        self.reset, self.playing = False, True

    def pause(self) -> None:
        self.playing = False

    def stop(self) -> None:
        self.playing, self.reset = False, True

    def advance(self) -> None:
        """The next frame, by the mode."""
        self.time, self.reset = 0, False
        last = len(self.durations) - 1
        to = self.frame + self.direction
        if 0 <= to <= last:
            self.frame = to
        elif self.direction > 0:
            if self.mode == FORWARD:
                self.stop()
            elif self.mode == FORWARD_LOOP:
                self.frame = 0
            else:
                self.direction, self.frame = -1, max(0, self.frame - 1)
        elif self.mode == BACKWARD_LOOP:
            self.direction, self.frame = 1, min(1, last)
        else:
            self.stop()

    def tick(self) -> None:
        if self.playing:
            self.time += 1
            if 0 <= self.frame < len(self.durations) and self.time >= self.durations[self.frame]:
                self.advance()


def tick_source(spark, sequences: DataFrame, per_second: int = 60) -> DataFrame:
    """A stream of (seq, tick, command): every sequence of (seq) is played and ticked ``per_second`` times a second.

    Ticks come from Spark's rate source, one partition; sequences are a static bank.
    """
    rate = spark.readStream.format("rate").option("rowsPerSecond", per_second).option("numPartitions", 1).load()
    ticks = rate.select(F.col("value").alias("tick"))
    return ticks.crossJoin(F.broadcast(sequences.select("seq").limit(MOST_SEQUENCES))).select("seq", "tick", F.when(F.col("tick") == 0, "play").otherwise("tick").alias("command"))


def play_stream(ticks: DataFrame, frames: DataFrame) -> DataFrame:
    """(seq, tick, frame_no, playing) of a stream of (seq, tick, command): play, pause, stop or tick.

    ``frames`` is a static bank (seq, frame_no, duration, mode); each sequence's frames, bounded by
    the format, come along as one array by a stream-static join. State is a player for each
    sequence. Ticks of one batch run in order of ``tick``.
    """
    bank = frames.groupBy("seq").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame_no", "duration"))), lambda x: x["duration"]).alias("durations"), F.min("mode").alias("mode"))
    rows = ticks.join(bank, "seq").select("seq", "tick", "command", "durations", "mode")

    def step(key, batches, state):
        pdf = pd.concat(list(batches)).sort_values("tick", kind="stable")
        player = Player([int(x) for x in pdf["durations"].iloc[0]], int(pdf["mode"].iloc[0]), state=tuple(state.get) if state.exists else None)
        out = []
        for tick, command in zip(pdf["tick"], pdf["command"], strict=True):
            getattr(player, command)()
            out.append((key[0], int(tick), player.frame, player.playing))
        state.update(player.state)
        yield pd.DataFrame(out, columns=["seq", "tick", "frame_no", "playing"])

    return rows.groupBy("seq").applyInPandasWithState(step, OUTPUT, STATE, "append", "NoTimeout")


__all__ = ["BACKWARD", "Player", "play_stream"]
