"""Quality rules by distribution divergence, in SQL functions only.

Each document has two histograms: characters by class, and words by common word of some language. A language's reference is
the sum of the histograms of the documents that carry its name. A document is rejected if it is far, in
Jensen-Shannon distance, from the nearest reference in either histogram, provided it is long enough to tell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import WHITE, let, materialise

#: Common words by language.
COMMON = {
    "en": "the of and to in is that for it as was with be on by this are or at from".split(),
    "fr": "de la le les et des en un du une que est pour qui dans sur par pas au avec".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo".split(),
}
WORDS = list(dict.fromkeys(w for words in COMMON.values() for w in words))
#: A sign for each common word: a run of code points without case or meaning of their own.
SIGNS = [chr(0x2800 + i) for i in range(len(WORDS))]
#: Classes of characters besides white space and a-z; what is left over is the last class.
CLASSES = {"upper": "\\p{Lu}", "letter": "[\\p{L}&&[^\\p{Lu}]]", "digit": "\\p{N}", "point": "[.,;:!?'\"()-]", "bar": "[|]", "symbol": "[#*$%&<>=+~^_/\\\\@{}\\[\\]]"}
N_CLASSES = len(CLASSES) + 2

#: Parameters: distances at which a document is rejected, and the least words to judge it by.
FAR_CHARS, FAR_WORDS, LEAST_WORDS = 0.23, 0.32, 50


def count_of(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, f"{pattern}+", ""))


def split_words(text: Column) -> Column:
    """Words between ASCII white space; an empty array for blank and null texts."""
    spaced = F.coalesce(text, F.lit(""))
    for c in "\t\n\x0b\x0c\r":
        spaced = F.replace(spaced, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(spaced, " "), "")  # splitting at one plain character needs no pattern


def repeated_words(words: Column) -> Column:
    """Words that lie in a three-word window found twice or more.

    Where the windows' 64-bit hashes aren't all different, windows are sorted by hash; the starts of those with an
    equal neighbour are put in order, and each covers up to three words that the one before doesn't.
    """

    def of(w: Column) -> Column:
        hashes = F.slice(F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))), 1, F.size(w) - 2)
        windows = lambda h: F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))

        def starts(s: Column) -> Column:
            twice = lambda j: (F.get(s, j)["h"] == F.get(s, j - 1)["h"]) | (F.get(s, j)["h"] == F.get(s, j + 1)["h"])
            return F.filter(F.transform(F.sequence(F.lit(0), F.size(s) - 1), lambda j: F.when(twice(j), F.get(s, j)["i"])), lambda x: x.isNotNull())

        def covered(at: Column) -> Column:
            return F.aggregate(at, F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")), lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n")))["n"]

        full = lambda h: let(F.sort_array(windows(h)), lambda s: let(F.sort_array(starts(s)), covered))
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(full(h)))

    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(of(words))


def features(text: Column, rules: bool = True) -> Column:
    """Struct: n_words, word_chars, chars and words (histograms); with `rules` also n_symbols, n_dup_lines and n_repeat_words."""
    t = F.coalesce(text, F.lit(""))
    listed = [*WORDS, *[w.capitalize() for w in WORDS]]

    def of(w: Column) -> Column:
        signs = F.array_join(F.transform(F.filter(w, lambda x: x.isin(listed)), lambda x: F.get(F.array(*map(F.lit, SIGNS)), F.array_position(F.array(*map(F.lit, WORDS)), F.lower(x)).cast("int") - 1)), "")
        rest = F.regexp_replace(t, f"[a-z{WHITE}]+", "")  # all classes but two are counted in what this leaves
        return F.struct(F.size(w).alias("n_words"), F.length(F.array_join(w, "")).alias("word_chars"), (repeated_words(w) if rules else F.lit(0).cast("long")).alias("n_repeat_words"), signs.alias("signs"), rest.alias("rest"))

    def histograms(x: Column) -> Column:
        common = [F.length(x["signs"]) - F.length(F.replace(x["signs"], F.lit(s), F.lit(""))) for s in SIGNS]
        counts = [count_of(x["rest"], p) for p in CLASSES.values()]
        chars = F.concat(F.array(x["word_chars"] - F.length(x["rest"])), let(F.array(*counts), lambda c: F.concat(c, F.array(F.length(x["rest"]) - F.aggregate(c, F.lit(0), lambda a, b: a + b)))))
        words = F.array(*common, x["n_words"] - F.length(x["signs"]))
        out = [x["n_words"].cast("long").alias("n_words"), x["word_chars"].cast("long").alias("word_chars"), chars.alias("chars"), words.alias("words")]
        if rules:
            lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{WHITE}]"))
            out += [count_of(x["rest"], "[#*$%&|<>]").cast("long").alias("n_symbols"), let(lines, lambda y: (F.size(y) - F.size(F.array_distinct(y))).cast("long")).alias("n_dup_lines"), x["n_repeat_words"].alias("n_repeat_words")]
        return F.struct(*out)

    return let(let(split_words(t), of), histograms)


def share(counts: Column) -> Column:
    """Counts divided by their sum; all zero where the sum is."""
    return let(F.aggregate(counts, F.lit(0.0), lambda a, b: a + b), lambda n: F.transform(counts, lambda x: x / F.greatest(n, F.lit(1.0))))


def js_distance(p: Column, q: Column) -> Column:
    """Square root of the Jensen-Shannon divergence in bits, 0 to 1."""
    part = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))
    terms = F.zip_with(p, q, lambda a, b: (part(a, (a + b) / 2) + part(b, (a + b) / 2)) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda x, y: x + y)))


def references(featured: DataFrame) -> dict[str, dict[str, list[float]]]:
    """For each language of COMMON the summed histograms (f.chars, f.words) of its documents, as shares.

    A language without documents has an empty histogram, from which every document is far. The driver gets one row a
    language, whatever the corpus.
    """
    sums = [F.array(*[F.sum(F.get(F.col(f"f.{kind}"), i)) for i in range(n)]).alias(kind) for kind, n in (("chars", N_CLASSES), ("words", len(WORDS) + 1))]
    rows = {r["lang"]: r for r in featured.filter(F.col("lang").isin(*COMMON)).groupBy("lang").agg(*sums).collect()}
    return {kind: {x: [v / max(1, sum(rows[x][kind])) for v in rows[x][kind]] if x in rows else [0.0] * n for x in COMMON} for kind, n in (("chars", N_CLASSES), ("words", len(WORDS) + 1))}


def judge(f: Column, fixed: dict[str, dict[str, list[float]]], far_chars: float = FAR_CHARS, far_words: float = FAR_WORDS, least_words: int = LEAST_WORDS, repeats: int = 50) -> Column:
    """Struct of base_failed, kept and both distances for a struct of features.

    The nearest reference counts, and only where there are `least_words` words. To have few common words is a sign of its own.
    """
    literal = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    nearest = lambda kind: let(share(f[kind]), lambda p: F.least(*[js_distance(p, literal(q)) for q in fixed[kind].values()]))
    base = (f["n_words"] < 50) | (100 * f["n_repeat_words"] > repeats * f["n_words"])

    def of(x: Column) -> Column:
        bad = (f["n_words"] >= least_words) & ((x["chars"] > far_chars) | (x["words"] > far_words))
        return F.struct(base.alias("base_failed"), (~base & ~bad).alias("kept"), x["chars"].alias("char_distance"), x["words"].alias("word_distance"))

    return let(F.struct(nearest("chars").alias("chars"), nearest("words").alias("words")), of)


def keep_good(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of `docs` that the rules keep, with all their columns."""
    fixed = references(docs.select("lang", features(F.col("text"), rules=False).alias("f")))
    # a column of features would be put into the filter once for each place that names it
    return docs.filter(let(features(F.col("text")), lambda f: judge(f, fixed, **parameters)["kept"]))


def quality_verdicts(docs: DataFrame, **parameters) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and both distances.

    Null and empty texts have no words, so they fail the base. The nearest reference counts, so a document with a null
    or wrong lang is judged like any other; documents with a lang outside COMMON add to no reference. Every row gives a row; an
    empty table gives none; other columns are ignored, whatever their names.
    """
    found = materialise(docs.select("doc_id", "lang", features(F.col("text")).alias("f")), "features")
    told = found.select("doc_id", "f", judge(F.col("f"), references(found), **parameters).alias("told"))
    return told.select("doc_id", *[f"f.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], "told.base_failed", "told.kept", *[F.round(f"told.{c}", 9).alias(c) for c in ("char_distance", "word_distance")])
