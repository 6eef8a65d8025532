"""Preparation of document text: sections, chunks, clean-up, headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.strings import ordered_join, strip

#: Words that make a line a heading, and what is suggested where a document offers none.
TOPICS = ["Introduction", "Overview", "Summary", "Background", "Objectives", "Methodology", "Approach", "Results", "Discussion", "Conclusion", "Features", "Requirements", "Limitations", "Future Work"]


#: Paragraphs that an inner fold walks over: what an appended array copies is bounded by it.
RUN = 256
#: Where lines end.
LINE_END = "\\r\\n|[\\n\\r\\x0B\\f\\x1C-\\x1E\\x85\\u2028\\u2029]"
SHEET = "# Sheet: "


def cuts_of(lengths: Column, size: int, overlap: int) -> Column:
    """Array of (at, tail): the paragraph that each chunk after the first begins with, and whether it carries the end of the one before.

    Only numbers are folded: the counted size and the length of the open chunk. The outer fold walks over runs of paragraphs, the inner one
    over those of a run, so an appended array is a run's or the list of runs, and time grows with the number of paragraphs.
    """
    cut = "struct<at: int, tail: boolean>"
    start = F.struct(F.array().cast(f"array<array<{cut}>>").alias("runs"), F.lit(0).alias("n"), F.lit(0).alias("open"))

    def step(acc: Column, p: Column) -> Column:
        room = (acc["n"] + p["n"] + 2 <= size) | (acc["open"] == 0)
        tail = acc["open"] > overlap if overlap else F.lit(False)
        carried = F.when(tail, overlap).otherwise(0)
        more = F.struct(acc["cuts"].alias("cuts"), (acc["n"] + p["n"] + 2).alias("n"), (F.when(acc["open"] == 0, 0).otherwise(acc["open"] + 2) + p["n"]).alias("open"))
        new = F.array_append(acc["cuts"], F.struct(p["at"].alias("at"), tail.alias("tail")))
        return F.when(room, more).otherwise(F.struct(new.alias("cuts"), (carried + p["n"] + 2).alias("n"), (F.when(tail, overlap + 2).otherwise(0) + p["n"]).alias("open")))

    def run(acc: Column, k: Column) -> Column:
        own = F.transform(F.slice(lengths, k * RUN + 1, RUN), lambda n, i: F.struct(n.alias("n"), (k * RUN + i).alias("at")))
        begin = F.struct(F.array().cast(f"array<{cut}>").alias("cuts"), acc["n"].alias("n"), acc["open"].alias("open"))
        done = F.aggregate(own, begin, step)
        return F.transform(F.array(done), lambda d: F.struct(F.array_append(acc["runs"], d["cuts"]).alias("runs"), d["n"].alias("n"), d["open"].alias("open")))[0]

    count = F.size(lengths)
    runs = F.when(count > 0, F.sequence(F.lit(0), F.floor((count - 1) / RUN).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(runs, start, run, lambda acc: F.flatten(acc["runs"]))


def chunks_of(text: Column, size: int = 1000, overlap: int = 200) -> Column:
    """Array of chunks: paragraphs packed while they fit; a chunk after the first starts with the end of the one before.

    A paragraph is never split. What a chunk starts with counts for it, and a chunk no longer than `overlap` hands nothing on. The text of a
    chunk is its paragraphs; the end of the one before is taken from the last paragraphs before it, which it ends with.
    """
    trimmed = F.filter(F.transform(F.split(strip(F.coalesce(text, F.lit(""))), "\\n\\s*\\n"), strip), lambda p: p != "")
    behind = overlap // 3 + 1  # paragraphs that hold `overlap` characters at least, each with a blank line

    def built(x: Column) -> Column:
        cuts = F.concat(F.array(F.struct(F.lit(0).alias("at"), F.lit(False).alias("tail"))), x["cuts"])

        def one(cut: Column, k: Column) -> Column:
            end = F.coalesce(F.get(x["cuts"], k)["at"], F.size(x["parts"]))
            first = F.greatest(F.lit(0), cut["at"] - behind)
            before = F.array_join(F.slice(x["parts"], first + 1, cut["at"] - first), "\n\n")
            own = F.array_join(F.slice(x["parts"], cut["at"] + 1, end - cut["at"]), "\n\n")
            return F.when(cut["tail"], F.concat(F.right(before, F.lit(overlap)), F.lit("\n\n"), own)).otherwise(own)

        return F.when(F.size(x["parts"]) > 0, F.transform(cuts, one)).otherwise(F.array().cast("array<string>"))

    once = lambda value, body: F.transform(F.array(value), body)[0]
    return once(trimmed, lambda parts: once(F.struct(parts.alias("parts"), cuts_of(F.transform(parts, F.length), size, overlap).alias("cuts")), built))


def chunk(docs: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    """doc_id, chunk (from 0), text."""
    return docs.select("doc_id", F.posexplode(chunks_of(F.col("text"), size, overlap)).alias("chunk", "text"))


def sections_of(text: Column) -> Column:
    """Array of (section, sheet, text): cut at lines `# Sheet: name`, bodies trimmed, blank ones dropped, names trimmed (null if empty); a text without
    such lines is one section, as it stands. Section is the number of the part among all."""
    whole = F.coalesce(text, F.lit(""))
    parts = F.split(F.concat(F.lit("\n"), F.regexp_replace(whole, LINE_END, "\n")), f"\\n(?={SHEET})")

    def section(part: Column, k: Column) -> Column:
        named = part.startswith(SHEET)
        name = F.nullif(strip(F.substring_index(F.substring(part, len(SHEET) + 1, 1 << 30), "\n", 1)), F.lit(""))
        body = F.when(named, F.regexp_replace(part, "^[^\\n]*", "")).otherwise(part)
        return F.struct(k.alias("section"), F.when(named, name).alias("sheet"), strip(body).alias("text"))

    alone = F.array(F.struct(F.lit(0).alias("section"), F.lit(None).cast("string").alias("sheet"), whole.alias("text")))
    cut = F.when((F.size(parts) == 1) & ~parts[0].startswith(SHEET), alone).otherwise(F.transform(parts, section))
    return F.filter(cut, lambda x: strip(x["text"]) != "")


def split_sections(docs: DataFrame) -> DataFrame:
    """doc_id, section, sheet, text (see sections_of)."""
    return docs.select("doc_id", F.explode(sections_of(F.col("text"))).alias("x")).select("doc_id", "x.*")


def index_chunks(docs: DataFrame, size: int = 1000, overlap: int = 200, embed=None) -> DataFrame:
    """chunk_id, doc_id, chunk (running number over sections), filename, sheet, text; with `embed`, which takes chunks (doc_id, pos, filename, sheet,
    text) and gives those that it could embed back with a column embedding, also that: chunks without one are left out before chunks are numbered.
    """
    of_section = lambda x: F.transform(chunks_of(x["text"], size, overlap), lambda t: F.struct(x["sheet"].alias("sheet"), t.alias("text")))
    all_ = F.filter(F.flatten(F.transform(sections_of(F.col("text")), of_section)), lambda x: strip(x["text"]) != "")
    parts = docs.select("doc_id", F.coalesce("filename", F.lit("document.txt")).alias("filename"), F.posexplode(all_).alias("pos", "x")).select("doc_id", "pos", "filename", "x.*")
    if embed is None:
        rows, more = parts.withColumnRenamed("pos", "chunk"), []
    else:
        n = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")) - 1
        rows, more = embed(parts).filter("embedding is not null").withColumn("chunk", n), ["embedding"]
    return rows.select(F.concat_ws("_", F.col("doc_id").cast("string"), F.col("chunk").cast("string")).alias("chunk_id"), "doc_id", "chunk", "filename", "sheet", "text", *more)


def rewrite(text: Column, *rules: tuple[str, str]) -> Column:
    for pattern, by in rules:
        text = F.regexp_replace(text, pattern, by)
    return strip(text)


def clean_selection(text: Column) -> Column:
    """Hyphenated and hard-wrapped lines joined, blank lines and bullets made uniform."""
    return rewrite(F.replace(F.coalesce(text, F.lit("")), F.lit("\r"), F.lit("")), ("([A-Za-z])-\\n+([A-Za-z])", "$1$2"), ("([^\\n])\\n(?!\\n)([a-z0-9(])", "$1 $2"), ("\\n\\s*\\n\\s*\\n+", "\n\n"), ("(?md)^\\s*[-•*]\\s*", "• "))


def format_answer(text: Column) -> Column:
    """Line breaks after sentences, before lists and after colons; uniform bullets and numbers."""
    return rewrite(
        F.coalesce(text, F.lit("")), ("\\n\\s*\\n\\s*\\n+", "\n\n"), ("[ \\t]+", " "), ("([\\p{L}\\p{N}_])\\. ([A-Z])", "$1.\n\n$2"), ("(?md)^\\s*[-•*]\\s*", "• "),
        ("(?md)^\\s*(\\d+)\\.\\s*", "$1. "), ("([.!?])\\s*(•|\\d+\\.)", "$1\n\n$2"), (":(\\s*)(•|\\d+\\.)", ":\n\n$1$2"), ("([^:\\n]):\\s*\\n", "$1:\n\n"),
    )


def headings(docs: DataFrame, limit: int = 6) -> DataFrame:
    """doc_id, rank, heading: the first distinct lines that look like one."""
    line = F.col("line")
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\\r\\n|[\\n\\r]")).alias("pos", "raw")).select("doc_id", "pos", strip(F.col("raw")).alias("line")).filter((line != "") & (F.length("line") <= 100))
    long_ = F.length("line").between(3, 80)
    looks = line.rlike("^\\d+(\\.\\d+){0,3}\\s+.{3,80}$") | ((line == F.upper(line)) & long_) | (line.endswith(":") & long_) | F.lower(line).rlike("|".join(t.lower() for t in TOPICS)) | ((F.size(F.split(line, "\\s+")) <= 8) & line.rlike("^\\p{Lu}"))
    key = F.regexp_replace(F.lower(line), "^:+|:+$", "")
    first = lines.filter(looks).groupBy("doc_id", key.alias("key")).agg(F.min(F.struct("pos", "line")).alias("x"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("x.pos"))
    return first.withColumn("rank", rank).filter(F.col("rank") <= limit).select("doc_id", "rank", F.regexp_replace("x.line", "[: .]+$", "").alias("heading"))


def suggest_topics(docs: DataFrame, gate: DataFrame) -> DataFrame:
    """doc_id, topics: headings, or the first six general ones where the document is withheld or offers none."""
    own = headings(docs).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "heading"))), lambda x: x["heading"]).alias("own"))
    general = F.array(*map(F.lit, TOPICS[:6]))
    return docs.select("doc_id").join(own, "doc_id", "left").join(gate.select("doc_id", "allowed"), "doc_id", "left").select("doc_id", F.when(F.coalesce("allowed", F.lit(True)), F.coalesce("own", general)).otherwise(general).alias("topics"))
