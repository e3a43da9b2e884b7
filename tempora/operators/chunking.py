"""From words to sentences to chunks: interval joins with scenes and the greedy chunker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ends_sentence
from ..sources.staging import stage

MAX_CHARS, MAX_SECONDS, EPSILON = 400, 15.0, 1e-6
#: The narrowest and widest buckets of scenes, as powers of two of a second.
LEVELS = -10, 60
#: Rows of a block of the timeline, more where a chunk may hold more; monotonically_increasing_id() holds the partition above these bits.
BLOCK_ROWS, PLACE_BITS = 512, 33


def sentences(words: DataFrame, keys: list[str]) -> DataFrame:
    """keys, sentence_no, text, start, end. words: keys, i, word, start, end.

    A sentence ends after a word that holds a terminator; words are trimmed and joined by a space, blank ones are left
    out, and a sentence of blank words alone is dropped.
    """
    before = Window.partitionBy(*keys).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    numbered = words.withColumn("sentence_no", F.coalesce(F.sum(ends_sentence(F.col("word")).cast("int")).over(before), F.lit(0)))
    told = F.filter(F.transform(F.array_sort(F.collect_list(F.struct("i", F.trim("word").alias("w")))), lambda x: x["w"]), lambda w: w != "")
    out = numbered.groupBy(*keys, "sentence_no").agg(F.array_join(told, " ").alias("text"), F.min_by("start", "i").alias("start"), F.max_by("end", "i").alias("end"))
    return out.filter("text <> ''")


def scene_at(rows: DataFrame, scenes: DataFrame, at: Column, key: list[str], into: str = "scene_index") -> DataFrame:
    """rows with the scene that holds the time `at`; see `scenes_at`."""
    return scenes_at(rows, scenes, {into: at}, key)


def scenes_at(rows: DataFrame, scenes: DataFrame, times: dict[str, Column], key: list[str]) -> DataFrame:
    """rows with the scene that holds each of the `times`, by name; rows keep their number.

    key: columns that tell rows apart. The first scene with start <= t < end counts; past the end of the last scene it
    is the last, anywhere else 0, also where a video has no scenes. Scenes and times meet in buckets of time by one equal
    join for all times, so that no video's scenes are compared with all of its rows. A scene's buckets are as wide as it is long, up to
    a power of two, so that it lies in three at most; a time looks into one bucket of each width that its video has.
    """
    bucket = lambda t, level: F.floor(t / F.pow(F.lit(2.0), level))
    level = F.least(F.greatest(F.ceil(F.log2(F.col("end_sec") - F.col("start_sec"))), F.lit(LEVELS[0])), F.lit(LEVELS[1]))
    spread = scenes.withColumn("_level", F.when(F.col("start_sec") < F.col("end_sec"), level))
    ends = spread.groupBy("vid_hash").agg(F.max_by("end_sec", "scene_index").alias("_end"), F.max("scene_index").alias("_last"), F.collect_set("_level").alias("_levels"))
    first = bucket(F.col("start_sec"), F.col("_level"))
    within = F.sequence(first, F.least(bucket(F.col("end_sec"), F.col("_level")), first + 2))
    spread = spread.filter("_level IS NOT NULL").select("vid_hash", F.col("scene_index").alias("_scene"), "start_sec", "end_sec", "_level", F.explode(within).alias("_b"))
    names = list(times)
    timed = rows.withColumn("_times", F.array(*[times[n].cast("double") for n in names])).join(ends, "vid_hash", "left")
    each = timed.select("vid_hash", *[k for k in key if k != "vid_hash"], "_levels", F.posexplode("_times").alias("_i", "_t"))
    each = each.withColumn("_level", F.explode("_levels")).withColumn("_b", bucket(F.col("_t"), F.col("_level"))).drop("_levels")
    # Spark does not see that scenes were made by exploding, and would broadcast them all.
    hit = each.join(spread.hint("merge"), ["vid_hash", "_level", "_b"]).filter("_t >= start_sec AND _t < end_sec")
    hit = hit.groupBy(*key).agg(*[F.min(F.when(F.col("_i") == i, F.col("_scene"))).alias(f"_found{i}") for i in range(len(names))])
    out = timed.join(hit, key, "left")
    scene = lambda i: F.coalesce(F.col(f"_found{i}"), F.when(F.get("_times", F.lit(i)) >= F.col("_end"), F.col("_last")), F.lit(0)).cast("int")
    return out.select(*rows.columns, *[scene(i).alias(n) for i, n in enumerate(names)])


def scene_keyframes(keyframes: DataFrame) -> DataFrame:
    """The first keyframe of each scene. keyframes: vid_hash, scene_index, ord, keyframe_path."""
    return keyframes.groupBy("vid_hash", "scene_index").agg(F.min_by("keyframe_path", "ord").alias("keyframe_path"))


def split_at(text: Column, start: Column, end: Column, boundary: Column) -> tuple[Column, Column]:
    """Both parts of a sentence that runs over a scene's end, cut in proportion to time; an empty part is the whole."""
    n = F.char_length(text)
    share = F.when(end > start, (boundary - start) / (end - start)).otherwise(0.5)
    at = F.least(F.greatest(F.lit(1), F.floor(n * share).cast("int")), F.greatest(n - 1, F.lit(1)))
    whole = F.trim(text)
    part = lambda t: F.when(F.trim(t) == "", whole).otherwise(F.trim(t))
    return part(F.substring(text, F.lit(1), at)), part(F.substring(text, at + 1, n))


def in_order(rows: DataFrame, *order: str) -> DataFrame:
    """rows with `g`, their place from 0 on: sorted by ranges, staged, and counted on from what the ranges before hold."""
    own = stage(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "timeline")
    part = F.shiftright("_at", PLACE_BITS)
    sizes, before, total = own.groupBy(part.alias("part")).count().collect(), {}, 0  # a row a range
    for r in sorted(sizes, key=lambda r: r.part):
        before[r.part], total = total, total + r["count"]
    offsets = F.broadcast(rows.sparkSession.createDataFrame(list(before.items()), "_part long, _before long"))
    placed = own.withColumn("_part", part).join(offsets, "_part")
    return placed.withColumn("g", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))).drop("_at", "_part", "_before")


def next_starts(placed: DataFrame, max_chars: int, max_seconds: float, block_rows: int) -> DataFrame:
    """block, vid_hash, g, next: where the chunk after one that opens at g would open, whether or not one opens there.

    A chunk has no more sentences than characters, so each row sees all it needs among the `max_chars` that follow: a block takes so
    many rows of the next one along.
    """
    own = F.floor(F.col("g") / block_rows)
    early = (F.col("g") % block_rows <= max_chars) & (F.col("g") >= block_rows)
    slim = placed.select("vid_hash", "g", "start", "first_scene", (F.col("first_scene") != F.col("last_scene")).alias("crosses"), F.char_length("text").cast("long").alias("n"), own.alias("own"))
    rows = slim.withColumn("block", F.explode(F.when(early, F.array("own", F.col("own") - 1)).otherwise(F.array("own"))))
    w = Window.partitionBy("block", "vid_hash")
    on = w.orderBy("g")
    rows = rows.withColumn("p", F.sum("n").over(on.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    changed = (F.lag("first_scene").over(on) != F.col("first_scene")) | F.col("crosses") | F.lag("crosses").over(on)
    rows = rows.withColumn("_breaks", F.when(F.coalesce(changed, F.lit(False)), F.col("g")))
    broken = F.min("_breaks").over(w.orderBy(F.desc("g")).rowsBetween(Window.unboundedPreceding, -1))
    # The first row with which the chunk would be too long, or the one after the last that is there.
    last = F.max(F.struct("g", (F.col("p") + F.col("n")).alias("upto"))).over(w.orderBy("p").rangeBetween(0, max_chars))
    # Times are compared by their difference: rows near the limit are looked at one by one.
    within = lambda what, lo, hi: F.expr(f"{what} OVER (PARTITION BY block, vid_hash ORDER BY start RANGE BETWEEN {lo} AND {hi!r}D FOLLOWING)")
    sure = within("max(g)", "CURRENT ROW", max_seconds - EPSILON)
    near = within("collect_list(struct(g, start))", f"{max_seconds - EPSILON!r}D FOLLOWING", max_seconds + EPSILON)
    rows = rows.withColumns({"_broken": broken, "_last": last, "_sure": sure, "_near": near})
    full = F.when(F.col("_last.upto") > F.col("p") + max_chars, F.col("_last.g")).otherwise(F.col("_last.g") + 1)
    in_time = F.size(F.filter("_near", lambda x: (x["g"] > F.col("_sure")) & (x["start"] - F.col("start") <= max_seconds)))
    late = F.greatest("_sure", "g") + 1 + in_time
    then = F.least(F.greatest(full, F.col("g") + 1), F.greatest(late, F.col("g") + 1), F.coalesce("_broken", F.max("g").over(w) + 1))
    return rows.withColumn("next", F.when(F.col("crosses"), F.col("g") + 1).otherwise(then)).filter("block = own").select("block", "vid_hash", "g", "next")


def block_entries(blocks: DataFrame, max_chars: int) -> DataFrame:
    """block, entry: the row of each block, from its first, at which the first chunk within it opens.

    blocks: block, nexts (of each row, from the block's first). A block maps each row at which it may be entered to the row at
    which the next one is. Most maps have one value, since a scene that ends in the block leads all ways together; the others are
    composed by pointer doubling until a block is reached whose entry is known.
    """
    size = F.size("nexts")
    # From the last row on: a row leads out of the block, or to a row whose way out is known.
    step = lambda acc, x: F.concat(F.array(F.when(x["to"] >= size, x["to"] - size).otherwise(F.get(acc, x["to"] - x["at"] - 1))), acc)
    back = F.reverse(F.transform("nexts", lambda to, at: F.struct(to.cast("int").alias("to"), at.alias("at"))))
    ways = F.slice(F.aggregate(back, F.array().cast("array<int>"), step), 1, max_chars + 1)
    told = blocks.select((F.col("block") + 1).alias("block"), F.col("block").alias("source"), ways.alias("ways"))
    known = lambda m: F.when(F.array_min(m) == F.array_max(m), F.array_min(m))
    told = blocks.select("block").join(told, "block", "left")
    told = told.withColumn("entry", F.when(F.col("source").isNull(), F.lit(0)).otherwise(known(F.col("ways"))))
    told = stage(told, "entries")
    while not told.filter("entry IS NULL").isEmpty():
        before = told.select(F.col("block").alias("source"), F.col("source").alias("further"), F.col("ways").alias("earlier"), F.col("entry").alias("known"))
        both = told.join(before, "source", "left")
        through = F.transform("earlier", lambda x: F.get(F.col("ways"), x))
        unknown = F.col("entry").isNull()
        told = stage(both.select(
            "block", F.when(unknown, F.col("further")).otherwise(F.col("source")).alias("source"), F.when(unknown, through).otherwise(F.col("ways")).alias("ways"),
            F.coalesce("entry", F.get("ways", F.col("known")), F.when(unknown, known(through))).alias("entry"),
        ), "entries")
    return told.select("block", "entry")


def chunk_numbers(placed: DataFrame, max_chars: int = MAX_CHARS, max_seconds: float = MAX_SECONDS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """placed with chunk_no and crosses: greedy chunks of each video's sentences in order.

    placed: vid_hash, ord, start, end, text, first_scene, last_scene. A sentence within one scene opens a new chunk if the scene
    changes, or if the open chunk would grow beyond `max_chars` or last more than `max_seconds` from its start. A sentence across
    scenes closes the open chunk and stands alone.

    The sentences of all videos are one timeline, cut into blocks of rows. Where the next chunk would open follows for each
    row from the rows after it, so that a block knows where it would be left for each way into it; the ways are joined from block to
    block, and only then is each block's own walked. A video of any length is spread over as many tasks as it has blocks.
    """
    block_rows = max(block_rows, max_chars + 1)
    own = in_order(placed, "vid_hash", "start", "ord")
    ahead = stage(next_starts(own, max_chars, max_seconds, block_rows), "next-starts")
    relative = F.transform(F.array_sort(F.collect_list(F.struct("g", "next"))), lambda x: (x["next"] - F.col("block") * block_rows).cast("int"))
    blocks = stage(ahead.groupBy("block").agg(relative.alias("nexts")), "blocks")
    entered = blocks.join(block_entries(blocks, max_chars), "block")
    start = F.struct(F.col("entry").alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda s, i: F.when(i == s["at"], F.struct(F.get("nexts", i).alias("at"), F.concat(s["out"], F.array(i)).alias("out"))).otherwise(s)
    opened = F.aggregate(F.sequence(F.lit(0), F.size("nexts") - 1), start, step, lambda s: s["out"])
    starts = entered.select("block", F.explode(opened).alias("i")).select((F.col("block") * block_rows + F.col("i")).alias("g"))
    starts = stage(ahead.join(starts, "g"), "starts")
    # A video's chunks are counted by blocks first.
    counts = starts.groupBy("vid_hash", "block").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("vid_hash").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = starts.withColumn("_i", F.row_number().over(Window.partitionBy("vid_hash", "block").orderBy("g")))
    numbered = numbered.join(counts.select("vid_hash", "block", before.alias("_before")), ["vid_hash", "block"])
    members = numbered.select(F.explode(F.sequence("g", F.col("next") - 1)).alias("g"), (F.col("_before") + F.col("_i")).cast("int").alias("chunk_no"))
    return own.join(members, "g").drop("g").withColumn("crosses", F.col("first_scene") != F.col("last_scene"))


def chunks(spoken: DataFrame, scenes: DataFrame, keyframes: DataFrame | None = None, max_chars: int = MAX_CHARS, max_seconds: float = MAX_SECONDS) -> DataFrame:
    """Time-aligned chunks. spoken: vid_hash, ord, text, start, end (a row a sentence).

    vid_hash, chunk_no, part (1, 2 for the halves of a sentence across scenes, else 0), chunk_id, parent_chunk_id,
    is_cross_scene_subchunk, scene_index, text, start, end, keyframe_path, sentence_count, weight. Videos without scenes
    have no chunks; a sentence over three scenes gives its first and last. Ids are hashes of the video and the place.
    """
    own = spoken.withColumn("text", F.trim("text")).filter("text <> ''").join(scenes.select("vid_hash").distinct(), "vid_hash", "left_semi")
    key = ["vid_hash", "ord"]
    placed = scenes_at(own, scenes, {"first_scene": F.col("start"), "last_scene": F.greatest(F.col("end") - EPSILON, F.col("start"))}, key)
    fields = ["vid_hash", "ord", "start", "end", "text", "first_scene", "last_scene"]
    told = stage(chunk_numbers(placed.select(*fields), max_chars, max_seconds), "chunked")

    order = F.struct("start", "ord")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "ord", "text"))), lambda s: s["text"]), " ")
    whole = told.filter("NOT crosses").groupBy("vid_hash", "chunk_no").agg(
        text.alias("text"), F.min("start").alias("start"), F.max_by("end", order).alias("end"), F.min("first_scene").alias("scene_index"), F.count(F.lit(1)).cast("int").alias("sentence_count")
    )
    whole = whole.select("vid_hash", "chunk_no", F.lit(0).alias("part"), "text", "start", "end", "scene_index", "sentence_count", F.lit(1).alias("weight"))
    ends = scenes.select("vid_hash", F.col("scene_index").alias("first_scene"), "end_sec")
    cut = told.filter("crosses").join(ends, ["vid_hash", "first_scene"])
    a, b = split_at(F.col("text"), F.col("start"), F.col("end"), F.col("end_sec"))
    half = lambda part, t, s, e, scene, w: F.struct(F.lit(part).alias("part"), t.alias("text"), s.alias("start"), e.alias("end"), scene.alias("scene_index"), F.lit(1).alias("sentence_count"), F.lit(w).alias("weight"))
    halves = cut.select("vid_hash", "chunk_no", F.explode(F.array(half(1, a, F.col("start"), F.col("end_sec"), F.col("first_scene"), 2), half(2, b, F.col("end_sec"), F.col("end"), F.col("last_scene"), 0))).alias("h"))
    out = whole.unionByName(halves.select("vid_hash", "chunk_no", "h.*"))

    name = lambda *c: F.sha2(F.concat_ws("|", "vid_hash", "chunk_no", *c), 256)
    out = out.withColumns({"is_cross_scene_subchunk": F.col("part") > 0, "chunk_id": name("part"), "parent_chunk_id": F.when(F.col("part") > 0, name())})
    if keyframes is None:
        return out.withColumn("keyframe_path", F.lit(None).cast("string"))
    return out.join(scene_keyframes(keyframes), ["vid_hash", "scene_index"], "left")


def with_keyframe(rows: DataFrame) -> DataFrame:
    """Chunks that have a keyframe: what an image encoder is given."""
    return rows.filter("keyframe_path IS NOT NULL AND keyframe_path <> ''")


def full_text(segments: DataFrame, keys: list[str], order: str = "segment_id") -> DataFrame:
    """keys, full_text: the texts of all segments in order, joined by a space. One recording's segments are one row."""
    told = F.array_sort(F.collect_list(F.struct(order, F.trim("text").alias("text"))))
    return segments.groupBy(*keys).agg(F.array_join(F.transform(told, lambda x: x["text"]), " ").alias("full_text"))


def align_images(rows: DataFrame, images: DataFrame, dim: int) -> DataFrame:
    """rows with their image vector by chunk_id, a zero vector where there is none."""
    zero = F.array_repeat(F.lit(0.0).cast("float"), dim)
    return rows.join(images.select("chunk_id", "image_dense"), "chunk_id", "left").withColumn("image_dense", F.coalesce("image_dense", zero))
