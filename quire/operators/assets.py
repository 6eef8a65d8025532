"""Curation of generated quizzes and flashcards, grading, and summary plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.strings import ordered_join, strip
from quire.operators.text import chunks_of, clean_selection

TRUE, FALSE = ["true", "t", "yes", "y", "1"], ["false", "f", "no", "n", "0"]


def parse_json(raw: Column) -> Column:
    """VARIANT of the whole text, else of its first fenced block, else of its outermost braces; null if none parses."""
    fence = F.nullif(F.regexp_extract(raw, "(?s)```(?:json)?\\s*(.*?)```", 1), F.lit(""))
    braces = F.nullif(F.regexp_extract(raw, "(?s)(\\{.*\\})", 1), F.lit(""))
    return F.coalesce(F.try_parse_json(raw), F.try_parse_json(strip(fence)), F.try_parse_json(braces))


def field(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, f"$.{path}", kind)


def elements(rows: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """A row for each element of the list `name` of the parsed `raw`: its position and value."""
    listed = F.try_variant_get(parse_json(F.col("raw")), f"$.{name}", "array<variant>")
    return rows.select(*keys, F.posexplode(listed).alias("_at", "_v"))


def clean_options(options: Column, answer: Column) -> Column:
    """Trimmed distinct options with the answer among them, five at most; null if fewer than three. An appended answer can fall off the end."""
    kept = F.filter(F.transform(F.coalesce(options, F.array().cast("array<string>")), strip), lambda x: x.isNotNull() & (x != ""))
    whole = F.when(F.array_contains(kept, answer), kept).otherwise(F.array_append(kept, answer))
    cut = F.slice(F.array_distinct(whole), 1, 5)
    return F.when(F.size(cut) >= 3, cut)


def clean_quiz(rows: DataFrame, n: int = 10) -> DataFrame:
    """request_id, position, type, question, options, correct_answer, explanation of the valid ones among the first n elements."""
    q = elements(rows, "questions", ["request_id"]).filter(F.col("_at") < n)
    v = F.col("_v")
    said = strip(field(v, "correct_answer"))
    kind, text = strip(F.lower(field(v, "type"))), strip(field(v, "question"))
    truth = F.when(F.lower(said).isin(TRUE), "true").when(F.lower(said).isin(FALSE), "false")
    rows_ = q.select("request_id", "_at", kind.alias("type"), text.alias("question"), F.when(kind == "true_false", truth).otherwise(said).alias("correct_answer"), field(v, "options", "array<string>").alias("_o"), F.coalesce(strip(field(v, "explanation")), F.lit("")).alias("explanation"))
    fine = rows_.filter(F.col("type").isin("mcq", "true_false", "short_answer") & (F.col("question") != "") & (F.col("correct_answer") != ""))
    options = F.when(F.col("type") == "mcq", clean_options(F.col("_o"), F.col("correct_answer"))).when(F.col("type") == "true_false", F.array(F.lit("true"), F.lit("false"))).otherwise(F.array().cast("array<string>"))
    out = fine.withColumn("options", options).filter("options is not null")
    return out.withColumn("position", F.row_number().over(Window.partitionBy("request_id").orderBy("_at"))).select("request_id", "position", "type", "question", "options", "correct_answer", "explanation")


def quiz_status(rows: DataFrame, n: int = 10) -> DataFrame:
    """request_id, status: invalid (no list of questions), empty (none valid) or ok."""
    good = clean_quiz(rows, n).groupBy("request_id").agg(F.count("*").alias("_n"))
    listed = F.try_variant_get(parse_json(F.col("raw")), "$.questions", "array<variant>").isNotNull()
    return rows.select("request_id", listed.alias("_l")).join(good, "request_id", "left").select("request_id", F.when(~F.col("_l"), "invalid").when(F.col("_n").isNull(), "empty").otherwise("ok").alias("status"))


def shorten(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most)), F.lit("…"))).otherwise(text)


def clean_cards(rows: DataFrame, k: int = 15) -> DataFrame:
    """request_id, round, at, front, back, category, difficulty of the first k elements that have front and back."""
    v = F.col("_v")
    c = elements(rows, "flashcards", ["request_id", "round"]).filter(F.col("_at") < k).select("request_id", "round", F.col("_at").alias("at"), strip(field(v, "front")).alias("front"), strip(field(v, "back")).alias("back"), strip(field(v, "category")).alias("category"), strip(field(v, "difficulty")).alias("difficulty"))
    fine = c.filter("front <> '' and back <> ''")
    level = F.initcap(F.lower("difficulty"))
    return fine.select("request_id", "round", "at", shorten(F.col("front"), 200).alias("front"), shorten(F.col("back"), 600).alias("back"), F.coalesce(F.nullif(F.col("category"), F.lit("")), F.lit("General")).alias("category"), F.when(level.isin("Easy", "Medium", "Hard"), level).otherwise("Medium").alias("difficulty"))


def assemble_deck(cards: DataFrame, n: int = 20, rounds: int = 3, each: int = 15) -> DataFrame:
    """request_id, position, front, back, category, difficulty: distinct cards, at most n (3 to 50), in the order of their rounds.

    A round asks for what is missing, at most `each`, and looks at no more of its elements (`at` under that number, whether or not they
    are cards); a round that adds none is the last. A request has at most rounds * each cards to fold.
    """
    n = max(3, min(50, n))
    card = F.struct("round", "at", "front", "back", "category", "difficulty")
    asked = cards.filter((F.col("round") <= rounds) & (F.col("at") < each)).groupBy("request_id").agg(F.array_sort(F.collect_list(card)).alias("cards"))
    kind = "array<struct<front: string, back: string, category: string, difficulty: string>>"
    start = F.struct(F.array().cast(kind).alias("kept"), F.lit(0).cast(cards.schema["round"].dataType).alias("round"), F.lit(0).alias("before"), F.lit(False).alias("over"))

    def step(acc: Column, c: Column) -> Column:
        size, new = F.size(acc["kept"]), c["round"] != acc["round"]
        # a new round ends it all if the one before added none, or wasn't there
        over = acc["over"] | (new & ((c["round"] != acc["round"] + 1) | ((acc["round"] > 0) & (size == acc["before"]))))
        before = F.when(new, size).otherwise(acc["before"])
        fits = ~over & (c["at"] < F.least(F.lit(each), n - before)) & (size < n) & ~F.exists(acc["kept"], lambda k: (k["front"] == c["front"]) & (k["back"] == c["back"]))
        one = F.struct(c["front"].alias("front"), c["back"].alias("back"), c["category"].alias("category"), c["difficulty"].alias("difficulty"))
        return F.struct(F.when(fits, F.array_append(acc["kept"], one)).otherwise(acc["kept"]).alias("kept"), c["round"].alias("round"), before.alias("before"), over.alias("over"))

    deck = asked.select("request_id", F.posexplode(F.aggregate("cards", start, step, lambda acc: acc["kept"])).alias("pos", "x"))
    return deck.select("request_id", (F.col("pos") + 1).alias("position"), "x.*")


def grade_quiz(answers: DataFrame, key: DataFrame) -> DataFrame:
    """request_id, score, total, percent, band: exact matches after trimming; unanswered questions count as wrong."""
    k = key.select("request_id", "position", strip(F.col("correct_answer")).alias("_k"))
    marked = k.join(answers.select("request_id", "position", strip(F.col("answer")).alias("_a")), ["request_id", "position"], "left")
    s = marked.groupBy("request_id").agg(F.sum(F.coalesce((F.col("_a") == F.col("_k")).cast("long"), F.lit(0))).alias("score"), F.count("*").alias("total"))
    p = F.round(100 * F.col("score") / F.col("total")).cast("long")
    return s.withColumn("percent", p).withColumn("band", F.when(F.col("percent") >= 90, "excellent").when(F.col("percent") >= 70, "good").when(F.col("percent") >= 50, "fair").otherwise("poor"))


def summary_plan(selections: DataFrame, style: str = "concise", bullets: bool = True) -> DataFrame:
    """request_id, step (single, map or reduce), chunk, text, target_words, form (bullets or paragraphs, of steps that read the text).

    A style that isn't known is concise for the parts and short for what merges them.
    """
    lengths = {"concise": "120-180", "detailed": "200-300", "short": "80-120"}
    words, merged, form = lengths.get(style, "120-180"), lengths.get(style, "80-120"), F.lit("bullets" if bullets else "paragraphs")
    step = lambda name, text, target, form: F.struct(F.lit(name).alias("step"), text.alias("text"), F.lit(target).alias("target_words"), form.alias("form"))
    reads = lambda name: lambda c: F.transform(c, lambda text: step(name, text, words, form))
    reduce = F.array(step("reduce", F.lit(None).cast("string"), merged, F.lit(None).cast("string")))
    # a text is cleaned and cut once, for the steps that read it and the one that merges them
    steps = F.transform(F.array(chunks_of(clean_selection(F.col("text")), 1600, 200)), lambda c: F.when(F.size(c) <= 1, reads("single")(c)).otherwise(F.concat(reads("map")(c), reduce)))[0]
    return selections.select("request_id", F.posexplode(steps).alias("chunk", "x")).select("request_id", "x.step", "chunk", "x.text", "x.target_words", "x.form")


def merge_partials(partials: DataFrame) -> DataFrame:
    """request_id, text, length: partial summaries that aren't blank, in order of chunk, a blank line between."""
    fine = partials.filter(strip(F.coalesce("text", F.lit(""))) != "").select("request_id", "chunk", strip(F.col("text")).alias("text"))
    return fine.groupBy("request_id").agg(ordered_join(["chunk"], "text", "\n\n").alias("text")).withColumn("length", F.length("text"))
