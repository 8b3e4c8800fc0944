"""Matches of queries and phrases in chunk texts, their rendering, and the boxes of matching chunks.

Texts may hold tags. They are searched without them, and an array of (place, length) of the tags maps places of the bare
text back to the original: a character's place there is its own plus the lengths of the tags that come before it. Places
count from 0 and ends stand behind the last character. A text's matches lie in one array, so nothing here is shuffled but
what is joined by chunk.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.functions.strings import WHITE
from docspark.operators import repairs
from docspark.sources.shared import once

TAG = r"<[^>]*>"
IN_WORD = r"[\p{L}\p{N}_]"
# fixed values: words that a query is not split into
STOP_WORDS = "a an and are as at be by for from has he in is it its of on that the to was will with me about tell".split()
LEAST_RATIO, WIDER = 0.75, 20
BLOCK_ROWS, BLOCK_CHARS = 256, 1 << 18  # phrases whose windows are bounded at once, and characters of their texts
MATCHES = "array<struct<start:int,end:int,text:string,match_type:string,similarity:double>>"


def _quoted(col: Column) -> Column:
    """A pattern that matches the text itself."""
    return F.regexp_replace(col, r"[^\p{L}\p{N}]", r"\\$0")


def _tags(text: Column) -> Column:
    """array<struct<at, size>>: where in the bare text each tag stood, and its length."""
    sizes = F.transform(F.regexp_extract_all(text, F.lit(TAG), F.lit(0)), F.length)
    gaps = F.transform(F.split(text, TAG, -1), F.length)
    put = lambda s, g, size: F.concat(s, F.array(F.struct((F.coalesce(F.try_element_at(s, F.lit(-1))["at"], F.lit(0)) + g).alias("at"), size.alias("size"))))
    pairs = F.zip_with(F.slice(gaps, 1, F.size(sizes)), sizes, lambda g, s: F.struct(g.alias("gap"), s.alias("size")))
    return F.aggregate(pairs, F.array().cast("array<struct<at:int,size:int>>"), lambda s, x: put(s, x["gap"], x["size"]))


def _original(tags: Column, at: Column) -> Column:
    return at + F.aggregate(tags, F.lit(0), lambda s, t: s + F.when(t["at"] <= at, t["size"]).otherwise(0))


def _starts(text: Column, pattern: Column) -> Column:
    """Places where a pattern without width matches. Splitting there keeps every character, so lengths of parts add up to
    the places; a match at the very beginning makes no part of its own."""
    parts = F.split(text, pattern, -1)
    added = F.aggregate(F.slice(F.transform(parts, F.length), 1, F.size(parts) - 1), F.array().cast("array<int>"), lambda s, n: F.concat(s, F.array(F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(0)) + n)))
    return F.when(F.rlike(text, F.concat(F.lit("^"), pattern)), F.concat(F.array(F.lit(0)), added)).otherwise(added)


def keyword_matches(chunks: DataFrame, query: Column, text_col: str = "text") -> DataFrame:
    """`chunks` with `matches`: every place of the query as a phrase, in any case and inside words too, overlapping ones as
    well; where there is none, its words instead, without stop words and those of one or two letters, with no letter,
    digit or underscore beside them. Of several that start at one place the first in the query stays. Null and blank
    queries and texts have no matches."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    q = F.lower(F.regexp_replace(F.coalesce(query, F.lit("")), f"^{WHITE}+|{WHITE}+\\z", ""))
    words = F.filter(F.split(q, f"{WHITE}+"), lambda w: (F.length(w) > 2) & ~w.isin(STOP_WORDS))
    rows = chunks.withColumns({"__q": q, "__words": words, "__bare": F.lower(F.regexp_replace(text, TAG, "")), "__tags": _tags(text)})
    ahead = lambda p: F.concat(F.lit("(?="), p, F.lit(")"))
    some = F.when(F.size("__words") > 0, F.concat(F.lit("(?:"), F.array_join(F.transform("__words", _quoted), "|"), F.lit(f")(?!{IN_WORD})")))
    rows = rows.withColumn("__phrases", F.when(F.col("__q") != "", _starts(F.col("__bare"), ahead(_quoted(F.col("__q"))))).otherwise(F.array().cast("array<int>"))).withColumn("__some", some)
    in_words = F.when((F.size("__phrases") == 0) & F.col("__some").isNotNull(), _starts(F.col("__bare"), F.concat(F.lit(f"(?<!{IN_WORD})"), ahead(F.col("__some"))))).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("__singles", in_words)
    size_at = lambda at: F.length(F.call_function("regexp_extract", F.substring(F.col("__bare"), at + 1, F.length("__bare")), F.concat(F.lit("^"), F.col("__some")), F.lit(0)))

    def match(at: Column, size: Column, kind: str) -> Column:
        start, end = _original(F.col("__tags"), at), _original(F.col("__tags"), at + size - 1) + 1
        return F.struct(start.alias("start"), end.alias("end"), F.substring(text, start + 1, end - start).alias("text"), F.lit(kind).alias("match_type"), F.lit(None).cast("double").alias("similarity"))

    found = F.concat(F.transform("__phrases", lambda p: match(p, F.length("__q"), "exact_phrase")), F.transform("__singles", lambda p: match(p, size_at(p), "word")))
    return rows.withColumn("matches", found.cast(MATCHES)).drop("__q", "__words", "__bare", "__tags", "__phrases", "__some", "__singles")


def merged(matches: Column) -> Column:
    """array<struct<start, end>>: matches by start, those that overlap or touch as one."""
    spans = F.array_sort(F.transform(matches, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"))))

    def add(done: Column, m: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        longer = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], m["end"]).alias("end"))))
        return F.when((F.size(done) > 0) & (m["start"] <= last["end"]), longer).otherwise(F.concat(done, F.array(m)))

    return F.aggregate(spans, F.array().cast("array<struct<start:int,end:int>>"), add)


def rendered(text: Column, matches: Column) -> Column:
    """The text with its merged matches in `<em>`."""
    part = lambda a, b: F.substring(text, a + 1, b - a)
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda s, m: F.struct(F.concat(s["out"], part(s["at"], m["start"]), F.lit("<em>"), part(m["start"], m["end"]), F.lit("</em>")).alias("out"), m["end"].alias("at"))
    return F.aggregate(merged(matches), start, step, lambda s: F.concat(s["out"], part(s["at"], F.length(text))))


def highlight(chunks: DataFrame, query: Column, text_col: str = "text", phrases: DataFrame | None = None, id_col: str = "chunk_id") -> DataFrame:
    """`chunks` with `matches`, of the query and then, if `phrases` (id, phrase) are given, of those that `locate_phrases`
    finds, and `highlighted`, the text with all in `<em>`."""
    rows = keyword_matches(chunks, query, text_col)
    if phrases is not None:
        found = locate_phrases(chunks.select(id_col, F.col(text_col).alias("text")), phrases, id_col)
        one = F.struct("start", "end", "text", F.lit("semantic").alias("match_type"), "similarity")
        fuzzy = found.groupBy(id_col).agg(F.array_sort(F.collect_list(one)).cast(MATCHES).alias("__fuzzy"))
        rows = rows.join(fuzzy, id_col, "left").withColumn("matches", F.concat("matches", F.coalesce("__fuzzy", F.array().cast(MATCHES)))).drop("__fuzzy")
    return rows.withColumn("highlighted", rendered(F.coalesce(F.col(text_col), F.lit("")), F.col("matches")))


def parse_phrases(output: Column) -> Column:
    """The phrases of a model's answer `{"phrases": [...]}`; of anything else none."""
    return F.coalesce(F.from_json(output, "phrases array<string>")["phrases"], F.array().cast("array<string>"))


def _alike(phrase: str, window: str) -> float:
    """SequenceMatcher's ratio. Below 200 characters it leaves out none, and its longest block, the first in the phrase and
    then in the window, is found by growing what the window holds of each place."""
    if len(window) >= 200:
        return SequenceMatcher(None, phrase, window).ratio()
    total, todo, find = 0, [(0, len(phrase), 0, len(window))], window.find
    while todo:
        low, high, left, right = todo.pop()
        size = first = place = 0
        for i in range(low, high):
            if high - i <= size:
                break
            while i + size < high and (found := find(phrase[i : i + size + 1], left, right)) >= 0:
                size, first, place = size + 1, i, found
        if size:
            total += size
            if low < first and left < place:
                todo.append((low, first, left, place))
            if first + size < high and place + size < right:
                todo.append((first + size, high, place + size, right))
    return 2.0 * total / (len(phrase) + len(window))


def _most_alike(text: str, phrase: str, windows, least: float) -> tuple[int, int, float] | None:
    """windows: (bound, place, size) from the highest bound on."""
    best = None
    for bound, at, size in windows:
        if bound <= least or best and bound < best[0]:
            break
        ratio = _alike(phrase, text[at : at + size])
        if ratio > least and (best is None or (ratio, -at, -size) > best):
            best = (ratio, -at, -size)
    return best and (-best[1], -best[1] - best[2], best[0])


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def best_window(text: str, phrase: str, least: float = LEAST_RATIO, wider: int = WIDER) -> tuple[int, int, float] | None:
    """(start, end, ratio) of the window as long as the phrase, or `wider` longer, that starts with its first character and
    is most like it; of equal ones the first, and of one place the shorter. Ratios count above `least` alone.

    The characters that a window shares with the phrase, in any order, bound its ratio, so windows are compared from the
    highest bound on, until the bounds fall below what is found."""
    n = len(phrase)
    if n > len(text):
        return None
    codes = _codes(text)
    letters, often = np.unique(_codes(phrase), return_counts=True)
    starts = np.flatnonzero(codes[: len(codes) - n + 1] == ord(phrase[0]))
    sizes = (n, n + wider)
    shared = [np.zeros(len(starts), np.int64) for _ in sizes]
    for letter, k in zip(letters.tolist(), often.tolist(), strict=True):
        before = np.append(0, np.cumsum(codes == letter))
        for size, total in zip(sizes, shared, strict=True):
            total += np.minimum(before[np.minimum(starts + size, len(codes))] - before[starts], k)
    bounds = np.concatenate([np.where(starts + size <= len(codes), 2.0 * total / (n + size), 0.0) for size, total in zip(sizes, shared, strict=True)])
    order = np.lexsort((np.tile(starts, 2), -bounds))
    return _most_alike(text, phrase, ((bounds[i], int(starts[i % len(starts)]), sizes[i // len(starts)]) for i in order.tolist()), least)


def best_windows(texts: list[str], phrases: list[str], least: float = LEAST_RATIO, wider: int = WIDER) -> list[tuple[int, int, float] | None]:
    """`best_window` of each text and phrase. For phrases of up to 64 characters the bound is the longest common
    subsequence, as matching blocks are one: it is counted for the windows of all texts at once, a character at a time,
    with a bit for each place of the phrase."""
    out: list[tuple[int, int, float] | None] = [None] * len(texts)
    blocks, room = [[]], BLOCK_CHARS
    for i, (text, phrase) in enumerate(zip(texts, phrases, strict=True)):
        if len(phrase) > 64 or len(text) > BLOCK_CHARS:
            out[i] = best_window(text, phrase, least, wider)
        elif 0 < len(phrase) <= len(text):
            if len(blocks[-1]) == BLOCK_ROWS or len(text) > room:
                blocks.append([])
                room = BLOCK_CHARS
            blocks[-1].append(i)
            room -= len(text)
    for block in filter(None, blocks):
        for i, found in zip(block, _short_windows([texts[i] for i in block], [phrases[i] for i in block], least, wider), strict=True):
            out[i] = found
    return out


def _short_windows(texts: list[str], phrases: list[str], least: float, wider: int) -> list[tuple[int, int, float] | None]:
    text, phrase = _codes("".join(texts)), _codes("".join(phrases))
    ends, sizes = np.cumsum([len(t) for t in texts]), np.array([len(p) for p in phrases])
    row, own = np.repeat(np.arange(len(texts)), [len(t) for t in texts]), np.repeat(np.arange(len(texts)), sizes)
    first = np.cumsum(sizes) - sizes
    number = np.zeros(max(text.max(), phrase.max()) + 1, np.int32)  # of a phrase's letter, 0 for others
    letters = np.unique(phrase)
    number[letters] = np.arange(1, len(letters) + 1)
    places = np.zeros((len(texts), len(letters) + 1), np.uint64)
    np.bitwise_or.at(places, (own, number[phrase]), np.uint64(1) << (np.arange(len(phrase)) - first[own]).astype(np.uint64))
    held = np.append(places[row, number[text]], np.zeros(64 + wider, np.uint64))
    starts = np.flatnonzero((text == phrase[first][row]) & (np.arange(len(text)) + sizes[row] <= ends[row]))
    starts = starts[np.argsort(-sizes[row[starts]], kind="stable")]
    n = sizes[row[starts]]
    state = np.full(len(starts), ~np.uint64(0))
    exact = state.copy()
    for k in range(int(n[0]) + wider if len(n) else 0):
        a, b = np.searchsorted(-n, (-k, -k + 1))
        exact[a:b] = state[a:b]
        live = np.searchsorted(-n, wider - k)  # windows that end after k
        v = state[:live]
        u = v & held[starts[:live] + k]
        state[:live] = (v + u) | (v - u)
    if not wider:
        exact = state
    low = ~np.uint64(0) >> (64 - n).astype(np.uint64)
    at, size = np.tile(starts, 2), np.concatenate([n, n + wider])
    common = np.tile(n, 2) - np.bitwise_count(np.concatenate([exact, state]) & np.tile(low, 2)).astype(np.int64)
    bounds = 2.0 * common / (np.tile(n, 2) + size)
    kept = np.flatnonzero((bounds > least) & (at + size <= ends[row[at]]))
    kept = kept[np.lexsort((at[kept], -bounds[kept], row[at[kept]]))]
    windows: dict[int, list] = {}
    for r, bound, place, long in zip(row[at[kept]].tolist(), bounds[kept].tolist(), (at - (ends - np.diff(ends, prepend=0))[row[at]])[kept].tolist(), size[kept].tolist(), strict=True):
        windows.setdefault(r, []).append((bound, place, long))
    return [_most_alike(t, p, windows[r], least) if r in windows else None for r, (t, p) in enumerate(zip(texts, phrases, strict=True))]


def locate_phrases(chunks: DataFrame, phrases: DataFrame, id_col: str = "chunk_id", least: float = LEAST_RATIO) -> DataFrame:
    """(id, phrase, start, end, text, similarity): where in its chunk's text, without tags and in any case, each phrase is
    most alike. chunks: id, text; phrases: id, phrase, one row each. Phrases of fewer than three characters, and those
    that nothing is like, have no row. What stands in the text as it is is found by Spark; a task compares the others."""
    bare = chunks.select(id_col, "text", F.lower(F.regexp_replace("text", TAG, "")).alias("bare"), _tags(F.col("text")).alias("tags"))
    want = phrases.select(id_col, "phrase", F.lower(F.trim("phrase")).alias("low")).where(F.length("low") >= 3)
    rows = want.join(bare, id_col).withColumn("at", F.position("low", "bare") - 1).where("at >= 0 OR length(low) <= length(bare)")
    schema = rows.select("*", F.col("at").alias("to"), F.lit(1.0).alias("similarity")).schema

    def run(batches):
        for batch in batches:
            low, at = batch["low"].to_pylist(), batch["at"].to_pylist()
            got = [(a, a + len(p), 1.0) if a >= 0 else None for a, p in zip(at, low, strict=True)]
            others = [i for i, g in enumerate(got) if g is None]
            unlike = batch["bare"].take(pa.array(others, pa.int32())).to_pylist()
            for i, found in zip(others, best_windows(unlike, [low[i] for i in others], least), strict=True):
                got[i] = found
            held = batch.filter(pa.array([g is not None for g in got], pa.bool_()))
            at, to, ratio = (list(x) for x in zip(*[g for g in got if g], strict=True)) if len(held) else ([], [], [])
            made = {"at": pa.array(at, pa.int32()), "to": pa.array(to, pa.int32()), "similarity": pa.array(ratio, pa.float64())}
            yield pa.RecordBatch.from_arrays([made[c] if c in made else held[c] for c in schema.names], names=schema.names)

    found = rows.mapInArrow(run, schema)
    start, end = _original(F.col("tags"), F.col("at")), _original(F.col("tags"), F.col("to") - 1) + 1
    return found.select(id_col, "phrase", start.alias("start"), end.alias("end"), F.substring(F.col("text"), start + 1, end - start).alias("found"), "similarity").withColumnRenamed("found", "text")


def highlight_boxes(chunks: DataFrame, page: Column | None = None, text: Column | None = None, most: int = 100) -> DataFrame:
    """(chunk_id, page, l, t, r, b, text): the boxes of chunks on a page, and whose text holds another in any case; null or
    missing conditions, page 0 and an empty text let all through. chunks: chunk_id, text, page_num, boxes; a box is JSON
    of one of three forms, with a page of its own in the first, four numbers or named sides in the others. Boxes without
    all four sides are left out; texts are cut to `most` characters."""
    rows = chunks.select("chunk_id", "text", "page_num", F.explode("boxes").alias("box"), *[c.alias(n) for c, n in ((page, "__page"), (text, "__text")) if c is not None])
    rows = once(rows.withColumn("box", repairs.bbox(F.col("box"), F.col("page_num"))), "box")
    sides = [F.col(f"box.{s}") for s in "ltrb"]
    rows = rows.where(F.col("box").isNotNull() & F.greatest(*[s.isNull() for s in sides]).eqNullSafe(False))
    if page is not None:
        rows = rows.where(F.coalesce(F.col("__page"), F.lit(0)).isin(0) | F.col("box.page").eqNullSafe(F.col("__page")))
    if text is not None:
        rows = rows.where((F.coalesce("__text", F.lit("")) == "") | F.contains(F.lower("text"), F.lower("__text")))
    return rows.select("chunk_id", F.col("box.page").alias("page"), *[s.alias(n) for s, n in zip(sides, "ltrb", strict=True)], F.substring("text", 1, most).alias("text"))
