"""URL filters: rules by host and path, and naive Bayes over segmented names for the rest.

Host labels are split into words by a unigram Viterbi search. Word counts come
from the visible text of the pages themselves. Substrings of the distinct labels meet
the counts in a join, so the dictionary is never gathered in one place. The words of
host and path of urls that a rule judges train a multinomial naive Bayes model;
it judges the others.

Cases: a null url, or one without ``://``, has an empty host and path, no rule, and no
evidence, so the prior decides; a label without known words stays whole; repeated
rows are judged alike (and learned from once for each distinct host and path);
null ids and other columns do not matter; an empty table gives an empty result, and with
one class unseen in training every other url is allowed. A rule whose path is empty
fits every url of its host, one without a path too.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.session import stage


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = ""

    @property
    def text(self) -> str:
        return f"{self.host}/{self.path}"


# Fixed values of the contract, as (verdict, host, path after the first slash).
RULES = (
    Rule("allow", "com", ""),
    Rule("block", "example.com", "en/"),
    Rule("allow", "www.example.com", "en/"),
    Rule("block", "net", "es/"),
    Rule("block", "net", "fr/"),
)
# The most letters of a host label, and so of a word in it.
MAX_WORD = 63
# Accented letters of Latin-1 and the letters they are read as.
ACCENTED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿß", "aaaaaaceeeeiiiinoooooouuuuyys"
# Scripts and styles up to their close tag, or to the end without one, and tags. Nothing is read twice, whatever is left open.
_HIDDEN = (
    r"(?is)<script[^<>]*+>(?:(?!</script>).)*+(?:</script>|$)|<style[^<>]*+>(?:(?!</style>).)*+(?:</style>|$)|<[^<>]*+>"
)
# Cost of a letter that no known word covers, in nats, and added counts per token.
UNKNOWN_LETTER, SMOOTHING = 9.0, 1.0


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _longest_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest rule (host and path together) that fits, as a struct, else null."""
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith("/" + rule.path)
        if not rule.path:
            fits = (host == rule.host) | host.endswith("." + rule.host)
        chosen = F.when(fits, F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def unigram_counts(pages: DataFrame) -> DataFrame:
    """``(word, n)`` of the words of all visible text, in lower case and without accents."""
    visible = F.regexp_replace(F.coalesce("html", F.lit("")), _HIDDEN, " ")
    folded = F.translate(F.lower(visible), ACCENTED, PLAIN)
    words = pages.select(F.explode(F.split(folded, "[^a-z]+")).alias("word"))
    return words.where(F.length("word").between(2, MAX_WORD)).groupBy("word").agg(F.count("*").alias("n"))


def segment(label: str, costs: dict[str, float]) -> list[str]:
    """The cheapest split of a label into words with the given costs.

    Letters that no word covers cost UNKNOWN_LETTER each and stay together.
    """
    best: list[tuple[float, int, bool]] = [(0.0, 0, True)]
    for end in range(1, len(label) + 1):
        options = [(best[end - 1][0] + UNKNOWN_LETTER, end - 1, False)]
        for begin in range(max(0, end - MAX_WORD), end):
            cost = costs.get(label[begin:end])
            if cost is not None:
                options.append((best[begin][0] + cost, begin, True))
        best.append(min(options))
    parts, end = [], len(label)
    while end:
        _, begin, known = best[end]
        parts.append((label[begin:end], known))
        end = begin
    words: list[str] = []
    open_run = False
    for part, known in reversed(parts):
        if not known and open_run:
            words[-1] += part
        else:
            words.append(part)
        open_run = not known
    return words


def _segment(batches):
    for batch in batches:
        words = []
        for label, known in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words.append(segment(label, {k["part"]: k["cost"] for k in known or []}))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.string()))], ["label", "words"])


def segmented_labels(hosts: DataFrame, counts: DataFrame) -> DataFrame:
    """``(label, words)`` of the distinct letter runs of hosts.

    A label's possible words, its substrings, meet their counts in a join and are grouped by label again.
    """
    total = counts.agg(F.sum("n"), F.count("*")).first()
    size = float((total[0] or 0) + (total[1] or 0) + 1)
    labels = hosts.select(F.explode(F.split("host", "[^a-z]+")).alias("label")).where("label != ''").distinct()
    parts = F.flatten(F.transform(F.sequence(F.lit(1), F.length("label")), lambda i: F.transform(
        F.sequence(F.lit(2), F.least(F.lit(MAX_WORD), F.greatest(F.lit(2), F.length("label") - i + 1))), lambda n: F.col("label").substr(i, n)
    )))
    spread = labels.select("label", F.explode(F.array_distinct(parts)).alias("part"))
    cost = counts.select(F.col("word").alias("part"), (math.log(size) - F.log(F.col("n") + 1)).alias("cost"))
    known = spread.join(cost, "part").groupBy("label").agg(F.collect_list(F.struct("part", "cost")).alias("known"))
    return labels.join(known, "label", "left").select("label", "known").mapInArrow(_segment, "label string, words array<string>")


def url_tokens(urls: DataFrame, labels: DataFrame) -> DataFrame:
    """``(host, path, token, n)``: words of host labels (``h:``) and of paths (``p:``)."""
    hosts = urls.select("host").distinct().select("host", F.explode(F.split("host", "[^a-z]+")).alias("label"))
    host_words = hosts.join(labels, "label").select("host", F.explode("words").alias("word")).groupBy("host", "word").agg(F.count("*").alias("n"))
    from_hosts = urls.select("host", "path").join(host_words, "host").select("host", "path", F.concat(F.lit("h:"), "word").alias("token"), "n")
    split = urls.select("host", "path", F.explode(F.split(F.lower("path"), "[^a-z]+")).alias("word")).where("word != ''")
    from_paths = split.groupBy("host", "path", "word").agg(F.count("*").alias("n"))
    return from_hosts.union(from_paths.select("host", "path", F.concat(F.lit("p:"), "word"), "n"))


def judged_urls(urls: DataFrame, labels: DataFrame) -> DataFrame:
    """``(host, path, log_odds)`` of block against allow for distinct urls with ``verdict`` (null: unjudged)."""
    tokens = stage(url_tokens(urls, labels).join(urls, ["host", "path"]), "tokens")
    blocked = F.when(F.col("verdict") == "block", F.col("n")).otherwise(0)
    allowed = F.when(F.col("verdict") == "allow", F.col("n")).otherwise(0)
    learned = tokens.where("verdict IS NOT NULL").groupBy("token").agg(F.sum(blocked).alias("b"), F.sum(allowed).alias("a"))
    sums = learned.agg(F.sum("b"), F.sum("a"), F.count("*")).first()
    priors = {r["verdict"]: r["n"] for r in urls.where("verdict IS NOT NULL").groupBy("verdict").agg(F.count("*").alias("n")).collect()}
    if "block" not in priors or "allow" not in priors:
        return urls.select("host", "path", F.lit(-1.0).alias("log_odds"))
    prior = math.log(priors["block"] / priors["allow"])
    size = SMOOTHING * (sums[2] or 0)
    shift = math.log(((sums[1] or 0) + size or 1) / ((sums[0] or 0) + size or 1))
    odds = learned.select("token", (F.log((F.col("b") + SMOOTHING) / (F.col("a") + SMOOTHING)) + shift).alias("w"))
    summed = tokens.where("verdict IS NULL").join(odds, "token").groupBy("host", "path").agg(F.sum(F.col("n") * F.col("w")).alias("s"))
    return urls.join(summed, ["host", "path"], "left").select("host", "path", (F.coalesce("s", F.lit(0.0)) + prior).alias("log_odds"))


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``(page_id, host, path, rule, verdict, log_odds)`` of every page."""
    host, path = split_url(F.col("url"))
    placed = pages.select("page_id", host.alias("host"), path.alias("path"))
    ruled = _longest_rule(F.col("host"), F.col("path"), rules)
    urls = stage(placed.select("host", "path").distinct().withColumn("r", ruled).select("host", "path", "r.rule", "r.verdict"), "urls")
    labels = stage(segmented_labels(urls.select("host").distinct(), unigram_counts(pages)), "labels")
    scored = judged_urls(urls, labels).join(urls, ["host", "path"])
    verdict = F.coalesce("verdict", F.when(F.col("log_odds") > 0, "block").otherwise("allow"))
    return placed.join(scored.withColumn("verdict", verdict), ["host", "path"]).select("page_id", "host", "path", "rule", "verdict", "log_odds")
