"""URL filter: rules first, then segmented host and path words.

A rule (verdict, host, path) fits its host and all subdomains where the url's
path starts with the rule's; the longest wins. Other urls are judged by a
multinomial naive Bayes over words: unigram Viterbi splits each host and path
token into words (unigrams counted over the text of all pages), and the classes
are learned from all urls that a rule decides. Each word has its own counts, smoothed
by one over the distinct words of these urls; words that none of them holds say nothing.

The unigram table stays whole and in Spark. Each distinct token is segmented once:
the distinct substrings of a part (a bounded number of tokens) are joined with the
table (of long words by their first letters), so a task holds the counts that its own
tokens can use and few others. Urls
are judged in parts as well, by the log odds of the tokens that occur in them.

Defined cases: a NULL url or one without ``://`` has empty host and path and
is judged by the class counts alone; NULL html holds no words; ties, and tables
that teach nothing, allow; repeated rows count as often as they occur; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import string
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import work_table

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
PIECES = 1 << 18  # substrings of a part of the tokens, or those of one token
START = 32  # longer words are looked up by their first letters, so no substring is longer
LETTERS = 1 << 17  # size of a part of the urls: their characters and 64 for each
ALLOW, BLOCK = "allow", "block"
VERDICTS = (ALLOW, BLOCK)


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; NULL where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule, verdict = F.when(fits, F.lit(name + start)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


# -- words -----------------------------------------------------------------
def unigrams(html: Column, pages: DataFrame) -> tuple[DataFrame, int, list[int]]:
    """(word, n) of all words of all pages' text, the count of all words together,
    and the lengths that words have."""
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>", " ")
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), 1)
    counts = work_table(pages.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")), "unigrams")
    facts = counts.agg(F.sum("n").alias("total"), F.collect_set(F.length("word")).alias("lengths")).first()
    return counts, facts["total"] or 0, sorted(facts["lengths"])


def tokens_of(host: str, path: str) -> list[str]:
    """Tokens of a host (``h:``) and path (``p:``); every run of digits is ``#``."""
    return [
        kind + ("#" if token[0].isdecimal() else token)
        for kind, text in (("h:", host), ("p:", path.lower()))
        for token in re.findall(r"\d+|[^\W\d_]+", text)
    ]


class Words:
    """Unigram Viterbi segmentation."""

    def __init__(self, counts: dict[str, int], total: int):
        self.total = max(1, total)
        self.cost = {w: math.log(self.total / n) for w, n in counts.items()}
        self.lengths = sorted({len(w) for w in counts}, reverse=True)

    def _unknown(self, n: int) -> float:
        """A word not seen: the less likely, the longer."""
        return math.log(self.total) + n * math.log(10)

    def segment(self, token: str) -> tuple[str, ...]:
        # An unknown word costs the same wherever it ends but for its length, so the best
        # start of one is the least of best[start] - start * log(10). A known word
        # costs less than it would unknown, so every start may count as unknown.
        best, back, least, start_of_least = [0.0], [0], math.inf, 0
        for end in range(1, len(token) + 1):
            if (x := best[-1] - (end - 1) * math.log(10)) < least:
                least, start_of_least = x, end - 1
            cost, start = best[start_of_least] + self._unknown(end - start_of_least), start_of_least
            for n in self.lengths:
                if n <= end and (known := self.cost.get(token[end - n : end])) is not None and best[end - n] + known < cost:
                    cost, start = best[end - n] + known, end - n
            best.append(cost)
            back.append(start)
        out, at = [], len(token)
        while at:
            out.append(token[back[at] : at])
            at = back[at]
        return tuple(reversed(out))

    def of(self, host: str, path: str) -> list[str]:
        """Words of a host (``h:``) and path (``p:``); runs of digits are one word."""
        return [t[:2] + w for t in tokens_of(host, path) for w in ((t[2:],) if t[2:] == "#" else self.segment(t[2:]))]


def _parts(size: Callable[[pa.RecordBatch], list[int]], most: int):
    """Adds ``part``: the next rows of a task whose sizes are ``most`` at most together, or one row."""

    def run(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        number, fill = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            numbers = []
            for n in size(batch):
                if fill and fill + n > most:
                    number, fill = number + 1, 0
                fill += n
                numbers.append(number)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64())], [*batch.schema.names, "part"])

    return run


def _pieces(lengths: list[int]):
    """(part, piece): substrings of a part's tokens that have the length of a word or
    of its start; about ``PIECES`` of them are held at a time."""

    def run(batches: Iterator[pa.RecordBatch]):
        def rows():
            return pa.RecordBatch.from_arrays([pa.array([part] * len(held), pa.int64()), pa.array(held, pa.string())], ["part", "piece"])

        part, held = None, set()
        for batch in batches:
            for token, at in zip(batch.column("token").to_pylist(), batch.column("part").to_pylist(), strict=True):
                for n in lengths:
                    for first in range(0, len(token) - n + 1, PIECES):
                        if held and (at != part or len(held) > PIECES):
                            yield rows()
                            held = set()
                        part = at
                        held.update(token[k : k + n] for k in range(first, min(first + PIECES, len(token) - n + 1)))
        if held:
            yield rows()

    return run


def _segments(total: int):
    def run(key: tuple[pa.Scalar, ...], tokens: pa.Table, known: pa.Table) -> pa.Table:
        words = Words(dict(zip(known["word"].to_pylist(), known["n"].to_pylist(), strict=True)), total)
        found = [words.segment(t) for t in tokens["token"].to_pylist()]
        return pa.table({"text": tokens["token"].cast(pa.string()), "words": pa.array(found, pa.list_(pa.string()))})

    return run


def segments(tokens: DataFrame, counts: DataFrame, total: int, lengths: list[int]) -> DataFrame:
    """(text, words): the segmentation of every distinct token (column ``token``)."""
    lengths = sorted({min(n, START) for n in lengths})
    size = lambda batch: [1 + len(t) * len(lengths) for t in batch.column("token").to_pylist()]
    tokens = work_table(tokens.distinct().mapInArrow(_parts(size, PIECES), "token string, part long"), "tokens")
    pieces = tokens.mapInArrow(_pieces(lengths), "part long, piece string")
    known = pieces.join(counts, F.col("piece") == F.substring("word", 1, START)).select("part", "word", "n")
    found = tokens.groupBy("part").cogroup(known.groupBy("part")).applyInArrow(_segments(total), "text string, words array<string>")
    return work_table(found, "segments")


# -- naive Bayes -----------------------------------------------------------
def _uses(batches: Iterator[pa.RecordBatch]):
    """(part, token, verdict, n): how often a part's urls of a verdict (NULL: still open) hold a token."""
    for batch in batches:
        counts: Counter = Counter()
        for part, host, path, verdict in zip(*[batch.column(c).to_pylist() for c in ("part", "host", "path", "verdict")], strict=True):
            counts.update((part, token, verdict) for token in tokens_of(host, path))
        columns = zip(*counts, strict=True) if counts else ([], [], [])
        types = (pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays(
            [*[pa.array(c, t) for c, t in zip(columns, types, strict=True)], pa.array(counts.values(), pa.int64())], ["part", "token", "verdict", "n"])


def learn(uses: DataFrame, split: DataFrame) -> DataFrame:
    """(token, odds): log odds, block against allow, of the words of each token."""
    times = lambda verdict: F.sum(F.when(F.col("verdict") == verdict, F.col("n")).otherwise(0))
    tokens = uses.groupBy("token").agg(*[times(v).alias(v) for v in VERDICTS])
    text = F.expr("substring(token, 3)")
    tokens = tokens.join(split, text == F.col("text"), "left")
    own = F.when(text == "#", F.array(F.lit("#"))).otherwise(F.col("words"))
    words = tokens.select("token", *VERDICTS, F.explode(own).alias("word"))
    words = words.withColumn("word", F.concat(F.substring("token", 1, 2), "word"))
    words = work_table(words, "url-words")
    counts = work_table(words.groupBy(F.col("word").alias("of")).agg(*[F.sum(v).alias(v) for v in VERDICTS]), "word-counts")
    counts = counts.where((F.col(ALLOW) > 0) | (F.col(BLOCK) > 0))
    sums = counts.agg(*[F.sum(v).alias(v) for v in VERDICTS], F.count(F.lit(1)).alias("words")).first()
    # add-one smoothing over the distinct words of the urls that a rule decides
    share = lambda verdict: F.log((F.col(verdict) + 1) / F.lit(float((sums[verdict] or 0) + sums["words"])))
    odds = counts.select("of", (share(BLOCK) - share(ALLOW)).alias("odds"))
    return words.select("token", "word").join(odds, F.col("word") == F.col("of")).groupBy("token").agg(F.collect_list("odds").alias("odds"))


def _judge(prior: float):
    def run(key: tuple[pa.Scalar, ...], urls: pa.Table, known: pa.Table) -> pa.Table:
        odds = dict(zip(known["token"].to_pylist(), known["odds"].to_pylist(), strict=True))
        verdicts = []
        for host, path in zip(urls["host"].to_pylist(), urls["path"].to_pylist(), strict=True):
            # fsum: the order of a token's odds does not matter
            score = math.fsum([prior, *[x for t in tokens_of(host, path) for x in odds.get(t, ())]])
            verdicts.append(BLOCK if score > 0 else ALLOW)
        return urls.select(["page_id", "host", "path", "rule"]).append_column("verdict", pa.array(verdicts, pa.string()))

    return run


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict), one row per page."""
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    urls = urls.withColumns({"rule": rule, "verdict": verdict})
    key = pages.schema["page_id"].dataType.simpleString()
    columns = f"page_id {key}, host string, path string, rule string, verdict string"
    size = lambda batch: [64 + len(h) + len(p) for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)]
    urls = work_table(urls.mapInArrow(_parts(size, LETTERS), f"{columns}, part long"), "urls")
    prior = dict.fromkeys(VERDICTS, 0) | {r.verdict: r.n for r in urls.groupBy("verdict").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not all(prior[v] for v in VERDICTS):  # one kind or none: that kind, or allow
        return urls.withColumn("verdict", F.coalesce("verdict", F.lit(BLOCK if prior[BLOCK] else ALLOW))).drop("part")
    uses = work_table(urls.select("part", "host", "path", "verdict").mapInArrow(_uses, "part long, token string, verdict string, n long"), "url-tokens")
    tokens = uses.select(F.expr("substring(token, 3)").alias("token")).where(F.col("token") != "#")
    odds = learn(uses, segments(tokens, *unigrams(F.col("html"), pages)))
    known = uses.where(F.col("verdict").isNull()).select("part", F.col("token").alias("of")).join(odds, F.col("of") == F.col("token"))
    known = known.select("part", "token", "odds")
    opened = urls.where(F.col("verdict").isNull())
    judged = opened.groupBy("part").cogroup(known.groupBy("part")).applyInArrow(_judge(math.log(prior[BLOCK] / prior[ALLOW])), columns)
    return urls.where(F.col("verdict").isNotNull()).drop("part").unionByName(judged)
