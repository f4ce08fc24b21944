"""Conversations, strategies, run metrics and timed segments, as windows and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_turns(turns: DataFrame, n: int) -> DataFrame:
    """Each conversation's last n turns, with their place from the end."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return turns.withColumn("back", F.row_number().over(w)).where(F.col("back") <= n)


def render_history(turns: DataFrame) -> DataFrame:
    """One text per conversation, a line a turn."""
    line = F.concat(F.initcap("role"), F.lit(": "), F.col("text"))
    kept = F.array_sort(F.collect_list(F.struct("turn", line.alias("line"))))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(kept, lambda x: x["line"]), "\n").alias("history"))


def strategy_stats(outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """outcomes (keys, confidence, success) to counts and sums, of which means follow."""
    return outcomes.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("confidence").alias("confidence"), F.count_if("success").alias("successes"))


def best_strategy(stats: DataFrame, key: str, least: int = 2) -> DataFrame:
    """Per key the strategy of the highest mean confidence times success rate, ties to the first name."""
    w = Window.partitionBy(key).orderBy(F.desc(F.round("score", 9)), "strategy")
    scored = stats.where(F.col("n") >= least).withColumn("score", F.col("confidence") / F.col("n") * F.col("successes") / F.col("n"))
    return scored.withColumn("place", F.row_number().over(w)).where("place = 1").select(key, "strategy", "score", (F.col("confidence") / F.col("n")).alias("confidence"))


def recommended(queries: DataFrame, outcomes: DataFrame, available: tuple[str, ...] = ("dense", "bm25", "hybrid")) -> DataFrame:
    """(query_id, strategy, confidence) for queries (query_id, pattern): the best strategy of the
    pattern, else of all outcomes (pattern, strategy, confidence, success), else hybrid at 0.5."""
    known = outcomes.where(F.col("strategy").isin(*available))
    own = best_strategy(strategy_stats(known, ["pattern", "strategy"]), "pattern").select("pattern", "strategy", "confidence")
    # one row
    every = best_strategy(strategy_stats(known.withColumn("all", F.lit(1)), ["all", "strategy"]), "all", 1).where("score > 0")
    every = every.agg(F.first("strategy").alias("s"), F.first("score").alias("c"))
    rows = queries.join(own, "pattern", "left").crossJoin(F.broadcast(every))
    return rows.select("query_id", F.coalesce("strategy", "s", F.lit("hybrid")).alias("strategy"), F.coalesce("confidence", "c", F.lit(0.5)).alias("confidence"))


def top_patterns(outcomes: DataFrame, k: int = 10) -> DataFrame:
    """The patterns of most queries."""
    return outcomes.groupBy("pattern").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "pattern").limit(k)


def first_steps(steps: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of each key the first row."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return steps.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")


def step_stats(steps: DataFrame, keys: list[str]) -> DataFrame:
    """steps (keys, ok, ms) to counts, successes, rate and latencies."""
    ms = [f("ms").alias(f"{n}_ms") for n, f in (("avg", F.avg), ("min", F.min), ("max", F.max))]
    return steps.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if("ok").alias("n_ok"), F.avg(F.col("ok").cast("int")).alias("rate"), *ms)


def histogram(values: DataFrame, bounds: list[float], value: str = "ms") -> DataFrame:
    """(bound, n): how many values are up to each bound, and all of them at infinity; one pass."""
    counts = values.agg(*[F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)], F.count(value).alias("all"))
    pairs = [F.struct(F.lit(float(b)).alias("bound"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)] + [F.struct(F.lit(float("inf")).alias("bound"), F.col("all").alias("n"))]
    return counts.select(F.explode(F.array(*pairs)).alias("x")).select("x.*")


def usage(calls: DataFrame, key: str = "tool") -> DataFrame:
    """(key, n, n_ok, n_failed, rate) of calls (key, ok)."""
    return calls.groupBy(key).agg(F.count("*").alias("n"), F.count_if("ok").alias("n_ok"), F.count_if(~F.col("ok")).alias("n_failed"), F.avg(F.col("ok").cast("int")).alias("rate"))


def kept_turns(turns: DataFrame, most: int = 50, ttl: float = 86_400.0, now: Column | None = None) -> DataFrame:
    """turns (conv_id, turn, at): a conversation's last ``most``, none older than ``ttl`` seconds."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("at"), F.desc("turn"))
    moment = F.unix_micros(F.current_timestamp()) / 1e6 if now is None else now
    return turns.where(F.col("at") > moment - ttl).withColumn("back", F.row_number().over(w)).where(F.col("back") <= most).drop("back")


def min_max(rows: DataFrame, key: str, value: str = "score") -> DataFrame:
    """value scaled to 0..100 within its key; 100 where all are equal."""
    w = Window.partitionBy(key)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return rows.withColumn(value, F.when(hi == lo, 100.0).otherwise(100 * (F.col(value) - lo) / (hi - lo)))


def chapters(segments: DataFrame, key: str, gap: float, longest: float | None = None) -> DataFrame:
    """segments (key, event_id, start, stop) with their chapter, from 1: one begins after a gap
    of over ``gap`` since the last stop, or where the chapter would get longer than ``longest``.

    Without ``longest`` a window does it; with it, what begins a chapter depends on where the
    last began, which is one fold over each key's ordered segments."""
    if longest is None:
        w = Window.partitionBy(key).orderBy("start", "event_id")
        begins = F.coalesce((F.col("start") - F.lag("stop").over(w)) > gap, F.lit(True))
        return segments.withColumn("begins", begins.cast("int")).withColumn("chapter", F.sum("begins").over(w)).drop("begins")

    def fold(frame):
        frame = frame.sort_values(["start", "event_id"])
        number, begin, last, out = 0, 0.0, None, []
        for start, stop in zip(frame["start"], frame["stop"], strict=True):
            if last is None or start - last > gap or stop - begin > longest:
                number, begin = number + 1, start
            last = stop
            out.append(number)
        return frame.assign(chapter=out)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in segments.schema)
    return segments.groupBy(key).applyInPandas(fold, f"{schema}, chapter long")


def cooled(events: DataFrame, key: str, gap: float) -> DataFrame:
    """(key, at): of events (key, at) the first, and each that comes ``gap`` after the last kept."""
    ordered = events.groupBy(key).agg(F.array_sort(F.collect_list("at")).alias("t"))
    step = lambda kept, t: F.when((F.size(kept) == 0) | (t - F.element_at(kept, -1) >= gap), F.array_append(kept, t)).otherwise(kept)
    return ordered.select(key, F.explode(F.aggregate("t", F.array().cast("array<double>"), step)).alias("at"))


def changes(frames: DataFrame, key: str, least: float) -> DataFrame:
    """(key, at, difference) of frames (key, at, pixels) that differ from the one before by a
    mean of ``least`` and more."""
    w = Window.partitionBy(key).orderBy("at")
    rows = frames.withColumn("before", F.lag("pixels").over(w)).where("before is not null")
    gap = F.zip_with("pixels", "before", lambda a, b: F.abs(a.cast("double") - b.cast("double")))
    mean = F.aggregate(gap, F.lit(0.0), lambda s, x: s + x) / F.size("pixels")
    return rows.select(key, "at", mean.alias("difference")).where(F.col("difference") >= least)


def frame_times(duration: Column, n: Column) -> Column:
    """n times evenly from 0 to the duration."""
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: i * duration / F.greatest(n - 1, F.lit(1)))


def scene_windows(recordings: DataFrame, key: str, size: float = 10.0, overlap: float = 2.0, most: int = 0) -> DataFrame:
    """(key, window_no, start, stop) of recordings (key, duration, scenes): a grid of overlapping windows, split at scene
    changes that aren't near an edge, within the recording and as long as the overlap at least; the first ``most`` if asked.

    A window is split by the changes inside it alone, one after the other, so each is folded for itself."""
    step = size - overlap if size > overlap else size
    n = F.greatest(F.lit(1), F.ceil((F.col("duration") - size) / step) + 1)
    pair = lambda a, b: F.struct(a.cast("double").alias("a"), b.cast("double").alias("b"))
    none = F.array().cast("array<struct<a:double,b:double>>")
    grid = F.when(F.col("duration") > 0, F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), lambda k: pair(k * step, k * step + size))).otherwise(none)

    def split(windows: Column, scene: Column) -> Column:
        both = lambda w: F.array(pair(w["a"], scene), pair(F.greatest(scene - overlap, w["a"]), w["b"]))
        return F.flatten(F.transform(windows, lambda w: F.when((scene - w["a"] > overlap) & (w["b"] - scene > overlap), both(w)).otherwise(F.array(w))))

    scenes = F.array_sort(F.filter(F.coalesce("scenes", F.array().cast("array<double>")), lambda s: s.isNotNull()))
    folded = F.flatten(F.transform(grid, lambda w: F.aggregate(F.filter(scenes, lambda s: (s > w["a"]) & (s < w["b"])), F.array(w), split)))
    cut = F.transform(folded, lambda w: pair(F.greatest(F.lit(0.0), w["a"]), F.least(w["b"], F.col("duration"))))
    whole = F.filter(cut, lambda w: w["b"] - w["a"] >= overlap)
    rows = recordings.select(key, F.posexplode(F.slice(whole, 1, most) if most > 0 else whole).alias("window_no", "w"))
    return rows.select(key, "window_no", F.col("w.a").alias("start"), F.col("w.b").alias("stop"))


def near_scene(windows: DataFrame, scenes: DataFrame, key: str, gap: float) -> DataFrame:
    """windows (key, start) that begin within ``gap`` of a scene change (key, at).

    Both are put into cells of the gap's width, so that a window meets the changes of three cells."""
    cell = lambda c: F.floor(F.col(c) / gap)
    wide = scenes.select(F.col(key).alias("_key"), F.col("at").alias("_at"), F.explode(F.array(cell("at") - 1, cell("at"), cell("at") + 1)).alias("_cell"))
    near = (F.col(key) == F.col("_key")) & (F.col("cell") == F.col("_cell")) & (F.abs(F.col("start") - F.col("_at")) <= gap)
    return windows.withColumn("cell", cell("start")).join(wide, near, "left_semi").drop("cell")


def transcript_chunks(segments: DataFrame, key: str, size: float = 60.0, overlap: float = 10.0) -> DataFrame:
    """(key, window_no, start, stop, n, content, language) of segments (key, event_id, start, stop,
    text, language): windows over a recording, the last cut at its end.  The language is the one of
    most segments, of equals the first to come."""
    step = max(size - overlap, 1.0)
    length = segments.groupBy(key).agg(F.max("stop").alias("duration"))
    wide = overlapping(segments, size, step, float("inf")).join(length, key)
    # the grid ends with the first window that reaches the end
    at = F.col("window_no") * step
    wide = wide.where((F.col("window_no") == 0) | (at - step + size < F.col("duration")))
    w = Window.partitionBy(key, "window_no", "language")
    counted = wide.withColumn("votes", F.count("*").over(w)).withColumn("first", F.min(F.struct("start", "event_id")).over(w))
    ordered = F.array_sort(F.collect_list(F.struct("start", "event_id", "text")))
    best = F.min(F.struct(-F.col("votes"), F.col("first"), F.col("language"))).alias("vote")
    out = counted.groupBy(key, "window_no", "duration").agg(F.count("*").alias("n"), F.trim(F.array_join(F.transform(ordered, lambda x: x["text"]), " ")).alias("content"), best)
    out = out.where("content != ''")
    return out.select(key, "window_no", at.alias("start"), F.least(at + size, F.col("duration")).alias("stop"), "n", "content", F.col("vote.language").alias("language"))


def caption_lines(windows: DataFrame) -> DataFrame:
    """windows (start, stop, caption) with ``content``: ``[12.0s-22.0s] caption``."""
    return windows.withColumn("content", F.format_string("[%.1fs-%.1fs] %s", "start", "stop", "caption"))


def overlapping(segments: DataFrame, size: float, step: float, longest: float) -> DataFrame:
    """(window_no, segment columns) for windows [i * step, i * step + size) that a segment
    (start, stop) overlaps: each segment lists its own windows, so nothing is compared."""
    low = F.greatest(F.lit(0), F.floor((F.col("start") - size) / step) + 1).cast("long")
    high = F.greatest(low, F.ceil(F.col("stop") / step).cast("long") - 1)
    wide = segments.withColumn("window_no", F.explode(F.sequence(low, high)))
    at = F.col("window_no") * step
    return wide.where((F.col("stop") > at) & (F.col("start") < at + size) & (at < longest))
