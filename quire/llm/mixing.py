"""Mixing documents to target weights by soft membership, in SQL functions only.

A naive Bayes classifier learnt from a labelled table gives each document posterior probabilities over domains. Rates (expected copies of a
document, not negative) are fitted by projected gradient so that the expected tokens of every domain,
sum of rate * tokens * posterior, match the targets in the least-squares sense.
"""

from __future__ import annotations

import warnings
from itertools import count
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import WHITE, free_name, let, materialise

#: Labelled documents learnt from (expected number, taken by hash of the id).
MOST_LABELLED = 20_000
#: A word counts for a domain if it is so many times as frequent there as in all documents, and if its log-likelihood ratio
#: against an even spread is so high that chance, over all words of a sample, doesn't reach it. No share of a domain's documents
#: is asked for, since words of a small language have a small one.
LEAST_LIFT, LEAST_RATIO = 3.0, 25.0
TOLERANCE = 1e-6
#: So many steps of the rates are replayed at most before the rates are written down.
REPLAY = 6
#: Decimals of the posteriors.
DIGITS = 6
#: Code points of a word's beginning, which counts as a word of its own with a star behind it.
BEGINNING = 5
#: Stands for a run of characters that are no letters, digits or white space.
MARK = "\x01"


def with_seen(docs: DataFrame, text: str, mark: str) -> DataFrame:
    """`docs` with a struct `mark` of what is seen in a text: n (words between white space), words (lower-cased, without what isn't a letter or digit
    at their ends; they can repeat) and signs (what the text looks like, as made-up words: shares of symbols and of repeated words, word length).

    Every step is a column of its own, so that it is worked out once.
    """
    keep = [F.col(f"`{c}`") for c in docs.columns]
    names = []

    def put(df: DataFrame, value: Column) -> tuple[DataFrame, str]:
        name = f"_{len(names)}"
        while name in df.columns:
            name += "_"
        names.append(name)
        return df.withColumn(name, value), name

    df, raw = put(docs, F.coalesce(F.col(f"`{text}`"), F.lit("")))
    # a run of other characters leaves one mark in its word, so that words of nothing else are counted too
    df, marked = put(df, F.regexp_replace(F.lower(raw), f"[^\\p{{L}}\\p{{N}}{WHITE}]+", MARK))
    df, all_ = put(df, F.split(marked, f"[{WHITE}]+"))
    df, words = put(df, F.array_distinct(all_))
    n = F.size(all_) - (F.get(all_, 0) == "").cast("int") - ((F.size(all_) > 1) & (F.element_at(all_, -1) == "")).cast("int")
    long_ = F.greatest(F.length(raw), F.lit(1))
    step = lambda name, x, *edges: F.concat(F.lit(name), *[F.when(x > e, F.lit("+")).otherwise(F.lit("")) for e in edges])
    signs = [
        step(" symbols", (long_ - F.length(marked)) / long_, 0.01, 0.05, 0.15),
        step(" long", long_ / F.greatest(n, F.lit(1)), 4, 9, 14),
        step(" repeats", 1 - F.size(words) / F.size(all_), 0.6, 0.85, 0.95),
    ]
    bare = F.transform(words, lambda w: F.trim(w, F.lit(MARK)))
    return df.select(*keep, F.struct(n.cast("long").alias("n"), bare.alias("words"), F.array(*signs).alias("signs")).alias(mark))


#: A word's beginning, and the beginnings in a bag, in SQL.
BEGIN = f"substring(w, 1, {BEGINNING})"
BEGUN = f"transform(array_distinct(transform({{0}}, w -> {BEGIN})), w -> concat(w, '*'))"


def literals(words: list[str]) -> str:
    return ", ".join("'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'" for w in words) or "''"


class Classifier:
    """Log weights by domain: a prior (no word present), and for each known word what it adds when present."""

    def __init__(self, domains: list[str], prior: list[float], words: list[str], weights: list[list[float]]):
        self.domains, self.prior, self.words, self.weights = domains, prior, words, weights

    def posterior(self, seen: str) -> Column:
        """Array of probabilities for a struct column `seen`, in the order of `domains`, rounded so that documents alike have the same.

        Only the few known words are looked up. It is SQL text, as thousands of literals take seconds to build one by one.
        """
        k = len(self.domains)
        if not self.words:
            return F.array(*[F.lit(1.0 / k)] * k)
        own, begun = ([w for w in self.words if w.endswith("*") == x] for x in (False, True))
        own_in, begun_in = f"w IN ({literals(own)})", f"{BEGIN} IN ({literals([w[:-1] for w in begun])})"
        few = f"filter(s.words, w -> {own_in} OR {begun_in})"
        known = f"concat(array_distinct(filter(few, w -> {own_in})), {BEGUN.format(f'filter(few, w -> {begun_in})')}, filter(s.signs, w -> {own_in}))"
        # maps are searched from their start, so there is one for each two letters that words begin with
        heads: dict[str, list[int]] = {}
        for i, w in enumerate(self.words):
            heads.setdefault(w[:2], []).append(i)
        maps = ", ".join(f"map_from_arrays(array({literals([self.words[i] for i in at])}), array({', '.join(map(str, at))}))" for at in heads.values())
        table = f"map_from_arrays(array({literals(list(heads))}), array({maps}))"
        hits = f"transform(array({few}), few -> transform({known}, w -> {table}[substring(w, 1, 2)][w]))[0]"
        sums = ", ".join(f"aggregate(at, {p!r}D, (a, j) -> a + get(array({', '.join(f'{row[i]!r}D' for row in self.weights)}), j))" for i, p in enumerate(self.prior))
        odds = "transform(logs, y -> exp(y - array_max(logs)))"
        shares = f"transform(odds, y -> round(y / aggregate(odds, 0D, (a, b) -> a + b), {DIGITS}))"
        let_ = lambda value, name, body: f"transform(array({value}), {name} -> {body})[0]"
        return F.expr(let_(f"`{seen}`", "s", let_(hits, "at", let_(f"array({sums})", "logs", let_(odds, "odds", shares)))))


def log_likelihood_ratio(inside: Column, all_: Column, share: float) -> Column:
    """G of `inside` of `all_` occurrences, where `share` of them would be expected."""
    part = lambda n, e: F.when(n > 0, n * F.log(n / e)).otherwise(F.lit(0.0))
    return 2 * (part(inside, all_ * share) + part(all_ - inside, all_ * (1 - share)))


def fit_classifier(labelled: DataFrame, domains: list[str]) -> Classifier:
    """Learns from rows (text, domain) whose domain is one of `domains`.

    Words count by presence and absence (Bernoulli), shape signs as categories, one of which is always present. Words are those
    with the most telling presence for each domain; as chance doesn't explain it, absent ones don't stand for a rare
    language. The driver gets their counts only.
    """
    bags = materialise(with_seen(labelled.filter(F.col("domain").isin(*domains)).select("domain", "text"), "text", "seen").select("domain", F.expr(f"concat(array_distinct(seen.words), {BEGUN.format('seen.words')}, seen.signs)").alias("bag")), "bags")
    sizes = {r["domain"]: r["n"] for r in bags.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    total, n = sum(sizes.values()), [sizes.get(d, 0) for d in domains]
    if not total:
        return Classifier(domains, [0.0] * len(domains), [], [])
    each = [F.sum((F.col("domain") == d).cast("long")).alias(f"n{i}") for i, d in enumerate(domains)]
    counts = materialise(bags.select("domain", F.explode("bag").alias("word")).filter("word not in ('', '*')").groupBy("word").agg(F.count("*").alias("n"), *each), "counts")
    known = counts.filter(F.col("word").startswith(" "))
    for i in range(len(domains)):
        if n[i]:
            lift = (F.col(f"n{i}") / n[i]) / (F.col("n") / total)
            sure = log_likelihood_ratio(F.col(f"n{i}"), F.col("n"), n[i] / total) >= LEAST_RATIO
            known = known.union(counts.filter((lift >= LEAST_LIFT) & sure))
    found = known.distinct().orderBy("word").collect()  # a few for each thousand labelled documents, and the signs
    prior = [log((k + 0.5) / (total + 0.5 * len(n))) for k in n]
    weights = []
    for r in found:
        there = [(r[f"n{i}"] + 0.5) / (k + 1.0) for i, k in enumerate(n)]
        absent = [0.0] * len(n) if r["word"].startswith(" ") else [log(1 - p) for p in there]
        prior = [a + b for a, b in zip(prior, absent)]
        weights.append([log(p) - a for p, a in zip(there, absent)])
    return Classifier(domains, prior, [r["word"] for r in found], weights)


def labelled_rows(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """text and domain of about `most` labelled documents, all if they are fewer.

    The sample's ids are bounded by `most`, so they are broadcast and no text is shuffled.
    """
    named = label_domains(labels)
    share = min(1.0, most / max(1, named.count()))
    some = named.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    return docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("text", "domain")


def fit_rates(docs: DataFrame, weights: list[float], scale: float, whole: int | None = None, steps: int | None = None, tolerance: float = TOLERANCE) -> list[list[float]]:
    """Steps of projected gradient over rows (n, p: posterior array): what each step takes off a document's rate, as
    the weights of its posteriors.

    The targets share out `scale` times all tokens by weight, or so many that the domain numbered `whole` gets `scale` times its
    own. Minimised is the sum over domains of (expected - target)^2 / available, from rates of one. A step scales each document's
    gradient by its tokens, so it takes off p . (expected - target) / available and clips at zero; a job adds up
    one number for each domain. It goes on until no domain is further than `tolerance` of all tokens from where the step before left
    it; only a caller who limits the `steps` gets rates that haven't settled, with a warning that says how far they are.
    """
    k = len(weights)
    # the rate depends on the posteriors only, so documents with the same ones step together
    rows = materialise(docs.groupBy("p").agg(F.sum("n").alias("n")), "rates").withColumn("r", F.lit(1.0))
    of = lambda r: [F.sum(r * F.col("n") * F.get("p", i)).alias(f"t{i}") for i in range(k)]
    have = [float(x or 0) for x in rows.agg(*of(F.lit(1.0))).first()]
    total = scale * (sum(have) if whole is None else have[whole] * sum(weights) / weights[whole])
    targets = [total * w / sum(weights) for w in weights]
    now, history, pending = list(have), [], []
    for _ in count() if steps is None else range(steps):
        g = [(now[i] - targets[i]) / have[i] if have[i] > 0 else 0.0 for i in range(k)]
        history.append(g)
        pending.append(g)
        r = stepped(F.col("r"), F.col("p"), pending)
        if len(pending) == REPLAY:
            rows, pending = materialise(rows.select("p", "n", r.alias("r")), "rates"), []
            r = F.col("r")
        before, now = now, [float(x or 0) for x in rows.agg(*of(r)).first()]
        left = max(abs(a - b) for a, b in zip(before, now)) / max(1.0, sum(have))
        if left <= tolerance:
            return history
    warnings.warn(f"the rates did not settle in {steps} steps: the last one moved a domain by {left:.2g} of all tokens", stacklevel=2)
    return history


def stepped(r: Column, p: Column, history: list[list[float]]) -> Column:
    """A rate after the steps: less each step's share, never under zero."""
    steps = F.array(*[F.array(*map(F.lit, g)) for g in history])
    part = lambda acc, g: F.greatest(F.lit(0.0), acc - F.aggregate(F.zip_with(p, g, lambda a, b: a * b), F.lit(0.0), lambda x, y: x + y))
    return F.aggregate(steps, r, part) if history else r


def label_domains(labels: DataFrame) -> DataFrame:
    """doc_id and domain of the labels table: toxic, low (of no quality) or good; unlabelled rows have none.

    Where rows about a document disagree, toxic comes before low and low before good.
    """
    grade = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 0)
    one = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max(grade).alias("grade")).filter("grade is not null")
    return one.select("doc_id", F.get(F.array(*map(F.lit, ("good", "low", "toxic"))), F.col("grade")).alias("domain"))


def weighed(docs: DataFrame, labels: DataFrame, weights: dict[str, float], scale: float, whole: str | None, most_labelled: int, mark: str, keep: list[str] | None = None) -> tuple[DataFrame, list[list[float]]]:
    """The rows of `docs` (columns `keep`, all by default) with a struct `mark` of n (words) and p (posteriors), written once
    so that no text is weighed again, and the rate steps.
    """
    classifier = fit_classifier(labelled_rows(docs, labels, most_labelled), list(weights))
    seen = free_name(docs, "seen")
    bags = with_seen(docs.select(*[F.col(f"`{c}`") for c in {*(keep or docs.columns), "text"}]), "text", seen)
    told = materialise(bags.select(*(keep or docs.columns), F.struct(F.col(f"{seen}.n").alias("n"), classifier.posterior(seen).alias("p")).alias(mark)), "posteriors")
    at = None if whole is None else list(weights).index(whole)
    return told, fit_rates(told.select(f"{mark}.n", f"{mark}.p"), list(weights.values()), scale, at)


def mixing_rates(docs: DataFrame, labels: DataFrame, weights: dict[str, float], scale: float = 1.0, whole: str | None = None, most_labelled: int = MOST_LABELLED) -> DataFrame:
    """doc_id, n_tokens, p_<domain> for each domain of `weights`, and rate (expected copies).

    Null and empty texts have no tokens and count as any text for the posteriors. Without labelled rows all domains
    are equally likely. A domain that no document may belong to leaves its target unmet. Labels that disagree about a
    document count once, the worst of them. Every row gives a row; an empty table gives none; other columns are ignored.
    """
    told, history = weighed(docs.select("doc_id", "text"), labels, weights, scale, whole, most_labelled, "told", ["doc_id"])
    compact = told.select("doc_id", "told.*")
    return compact.select("doc_id", F.col("n").alias("n_tokens"), *[F.get("p", i).alias(f"p_{d}") for i, d in enumerate(weights)], stepped(F.lit(1.0), F.col("p"), history).alias("rate"))


def drawn(docs: DataFrame, labels: DataFrame, weights: dict[str, float], scale: float = 1.0, whole: str | None = None, most_labelled: int = MOST_LABELLED) -> DataFrame:
    """The rows of `docs` drawn at their rates, with all their columns: a rate of 2.3 gives two copies, and a third in 3 of 10 documents.

    What a rate has over whole copies is drawn by a hash of id and text, so the draw doesn't change from run to run.
    """
    mark, copy = free_name(docs, "told"), free_name(docs, "copy")
    told, history = weighed(docs, labels, weights, scale, whole, most_labelled, mark)
    u = F.pmod(F.xxhash64(F.col("doc_id"), F.col("text"), F.lit("draw")), F.lit(1 << 30)) / float(1 << 30)
    copies = let(stepped(F.lit(1.0), F.col(f"{mark}.p"), history), lambda r: F.floor(r) + (r - F.floor(r) > u).cast("int"))
    return told.withColumn(copy, F.explode(F.array_repeat(F.lit(1), copies.cast("int")))).select(*docs.columns)
