"""Personal data: fixed patterns, and terms that give a protected entity away.

Base spans (code points, end exclusive) are leftmost non-overlapping matches per
kind; a match that fails its check is dropped. An entity is a kind with its exact match.
The words around a base span are its context; a word is a run between white space without the
marks at its edges, in lower case. Over the whole corpus, a term reveals
an entity when it occurs in enough of the entity's distinct contexts and its
pointwise information about the entity and the posterior probability of the entity
given the term are high: I(t, e) = log2(p(e | t) / p(e)), p(e | t) = (texts with t in a context of e) /
(texts with t), p(e) = (texts with e) / (texts), each over distinct texts. The information
is measured against the most there is to tell about the entity, -log2 p(e). Every
occurrence of such a term, in whatever text, becomes a span of the kind ``term`` unless
it overlaps a base span.

Cases: a null or empty text has no span; null ids and repeated rows are treated like
others (equal contexts count once); other columns are kept by ``sanitised`` and not
looked at; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.hashing import free_name, text_key, text_or_empty
from tokenloom.session import stage

KINDS = ("email", "ip", "card", "phone")
# The contract's patterns, with the same matches: a run is entered at its start only and never given back,
# so that long runs of digits or letters take linear time.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_NEEDS = {"email": "@", "phone": "+"}
# Words of context on each side, and the characters in which they are looked for first; distinct
# contexts, posterior and share of the entity's own information that make a term revealing.
CONTEXT_WORDS, CONTEXT_CHARS = 6, 160
MIN_CONTEXTS, MIN_POSTERIOR, MIN_INFORMATION = 3, 0.5, 0.5
# Candidate terms, or rows and spans, that may be broadcast; 20 bytes each on average at most.
BROADCAST_TERMS = 200_000
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]"}
_MATCHES = "array<struct<start:int,end:int,value:string>>"
_SPAN = "struct<start:int,rank:int,kind:string,end:int,value:string>"
_SPANS = f"array<{_SPAN}>"
# A run between white space, from its first letter or digit to its last.
_TERM = r"[\p{L}\p{N}](?:[^\x20\x09-\x0D]*[\p{L}\p{N}])?"
_FREE = r"[^\x20\x09-\x0D]*+"
_NEXT_RUNS = r"(?:[\x20\x09-\x0D]++[^\x20\x09-\x0D]++)"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        double = F.when(i % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)
        return total + double

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    digits = _digits(match)
    if kind == "ip":
        return match.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$")
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _matches(text: Column, pattern: str | Column, offset: Column) -> Column:
    """Matches as structs (start, end, value); the pieces between them and the matches
    alternate, so running sums of their lengths are places."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    pieces, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    begin = F.struct(offset.alias("at"), F.lit(0).alias("i"), pieces.alias("pieces"), F.array().cast(_MATCHES).alias("found"))

    def step(state: Column, m: Column) -> Column:
        start = state["at"] + F.length(F.get(state["pieces"], state["i"]))
        end = start + F.length(m)
        found = F.concat(state["found"], F.array(F.struct(start.alias("start"), end.alias("end"), m.alias("value"))))
        return F.struct(end.alias("at"), (state["i"] + 1).alias("i"), state["pieces"].alias("pieces"), found.alias("found"))

    return F.aggregate(matches, begin, step, lambda state: state["found"])


def _kind_spans(kind: str, text: Column) -> Column:
    """Spans of one kind as structs (start, rank, kind, end, value), in order."""
    valid = F.filter(_matches(text, PATTERNS[kind], F.lit(0)), lambda m: _valid(kind, m["value"]))
    spans = F.transform(valid, lambda m: _span(m, KINDS.index(kind), kind)).cast(_SPANS)
    possible = F.contains(text, F.lit(_NEEDS[kind])) if kind in _NEEDS else text.rlike("[0-9]")
    return F.when(possible, spans).otherwise(F.array().cast(_SPANS))


def _span(match: Column, rank: int, kind: str) -> Column:
    return F.struct(
        match["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), match["end"].alias("end"), match["value"].alias("value")
    )


def base_spans(text: Column) -> Column:
    """All base spans of a text by start, then kind."""
    return F.sort_array(F.concat(*(_kind_spans(kind, text) for kind in KINDS)))


def _terms(words: Column) -> Column:
    """Matches with their words in lower case."""
    return F.transform(words, lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"), F.lower(w["value"]).alias("value")))


def _context_words(text: Column, span: Column) -> Column:
    """The terms in the nearest runs on both sides of a span, with their places.

    What is joined to the span without white space is no word. The runs before it are
    looked for in a few characters first, and in all text before when these do not hold enough whole ones.
    """
    few = f"{{0,{CONTEXT_WORDS}}}"
    near = F.reverse(text.substr(F.greatest(F.lit(0), span["start"] - CONTEXT_CHARS) + 1, F.least(span["start"], F.lit(CONTEXT_CHARS))))
    whole = F.regexp_extract(near, f"^{_FREE}({_NEXT_RUNS}{{{CONTEXT_WORDS}}})[\\x20\\x09-\\x0D]", 1)
    far = F.reverse(text.substr(F.lit(1), span["start"]))
    attached = F.length(F.regexp_extract(far, f"^{_FREE}", 0))
    before = F.when(whole != "", whole).otherwise(F.regexp_extract(far, f"^{_FREE}({_NEXT_RUNS}{few})", 1))
    begin = span["start"] - attached - F.length(before)
    after = text.substr(span["end"] + 1, F.length(text))
    gap = F.length(F.regexp_extract(after, f"^{_FREE}", 0))
    following = F.regexp_extract(after, f"^{_FREE}({_NEXT_RUNS}{few})", 1)
    return _terms(F.concat(_matches(F.reverse(before), _TERM, begin), _matches(following, _TERM, span["end"] + gap)))


def found_spans(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_key, base, near)``: base spans, and for each of them its context words
    that are no part of a base span."""
    spanned = docs.select("doc_id", text_key().alias("text_key"), text_or_empty().alias("text")).withColumn("base", base_spans(F.col("text")))

    def free(words: Column) -> Column:
        return F.filter(words, lambda w: ~F.exists("base", lambda s: (w["start"] < s["end"]) & (s["start"] < w["end"])))

    near = F.transform("base", lambda s: free(_context_words(F.col("text"), s)))
    return spanned.select("doc_id", "text_key", "base", F.when(F.size("base") > 0, near).alias("near"))


def _words() -> Column:
    found = F.regexp_extract_all(text_or_empty(), F.lit(_TERM), F.lit(0))
    return F.explode(F.array_distinct(F.transform(found, F.lower))).alias("term")


def _small(terms: DataFrame) -> DataFrame:
    """``terms``, to be broadcast if it is small enough for that."""
    size = terms.agg(F.count("*"), F.sum(F.octet_length("term"))).first()
    return F.broadcast(terms) if size[0] <= BROADCAST_TERMS and (size[1] or 0) <= 20 * BROADCAST_TERMS else terms


def _bounded(rows: DataFrame, texts: str) -> bool:
    """Whether rows with lists of short texts are few and short enough to be broadcast."""
    octets = F.aggregate(texts, F.lit(0).cast("long"), lambda total, t: total + F.octet_length(t))
    n, items, size = rows.agg(F.count("*"), F.sum(F.size(texts)), F.sum(octets)).first()
    return n + (items or 0) <= BROADCAST_TERMS and (size or 0) <= 20 * BROADCAST_TERMS


def revealing_terms(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``(kind, value, term, n, posterior, bits)`` of the terms over the thresholds; ``n`` counts distinct texts.

    Contexts are narrow rows and equal ones of a text count once. Corpus frequencies
    are counted only for terms that the contexts alone do not rule out.
    """
    zipped = found.where(F.size("base") > 0).select("text_key", F.explode(F.arrays_zip("base", "near")).alias("s"))
    terms = F.array_sort(F.array_distinct(F.transform("s.near", lambda w: w["value"])))
    context = stage(zipped.select("text_key", "s.base.kind", "s.base.value", terms.alias("terms")).distinct(), "contexts")
    mentions = context.select("kind", "value", "text_key").distinct().groupBy("kind", "value").agg(F.count("*").alias("n_entity"))
    total = max(1, found.select("text_key").distinct().count())
    several = context.select("kind", "value", "terms").distinct().select("kind", "value", F.explode("terms").alias("term"))
    several = several.groupBy("kind", "value", "term").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_CONTEXTS).drop("n")
    held = context.select("kind", "value", F.explode("terms").alias("term"), "text_key").distinct()
    held = held.groupBy("kind", "value", "term").agg(F.count("*").alias("n"))
    pairs = stage(held.join(several, ["kind", "value", "term"]), "pairs")
    # A term is in as many texts as it is in contexts of any entity, or more; beyond n / MIN_POSTERIOR none of its entities stays.
    near = context.select(F.explode("terms").alias("term"), "text_key").distinct().groupBy("term").agg(F.count("*").alias("n_near"))
    most = pairs.groupBy("term").agg(F.max("n").alias("n_most"))
    candidates = stage(most.join(near, "term").where(F.col("n_most") >= MIN_POSTERIOR * F.col("n_near")).select("term"), "candidates")
    words = docs.select(text_key().alias("text_key"), _words()).join(_small(candidates), "term", "left_semi").distinct()
    frequency = words.groupBy("term").agg(F.count("*").alias("n_term"))
    posterior = F.col("n") / F.greatest("n", "n_term")
    own = F.log2(float(total) / F.col("n_entity"))
    scored = pairs.join(frequency, "term").join(mentions, ["kind", "value"]).select(
        "kind", "value", "term", "n", posterior.alias("posterior"), (F.log2(posterior) + own).alias("bits"), own.alias("own")
    )
    informed = (F.col("bits") > 0) & (F.col("bits") >= MIN_INFORMATION * F.col("own"))
    return scored.where((F.col("posterior") >= MIN_POSTERIOR) & informed).drop("own")


def term_spans(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``(text_key, terms)``: the spans of every occurrence of a revealing term, of each distinct text that has any.

    The words of all texts are joined with the terms first; places are looked for in
    the texts that have some.
    """
    known = _small(stage(terms.select("term").distinct(), "known"))
    keyed = docs.select(text_key().alias("text_key"), text_or_empty().alias("text"))
    hits = keyed.select("text_key", _words()).join(known, "term", "left_semi").groupBy("text_key").agg(F.collect_set("term").alias("own"))
    hits = stage(hits, "hits")
    if _bounded(hits, "own"):
        hits = F.broadcast(hits)
    else:
        keyed = keyed.dropDuplicates(["text_key"])
    literal = F.transform("own", lambda t: F.concat(F.lit(r"\Q"), F.replace(t, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")))
    # White space and marks before a term are matched with it; no letter or digit may follow in its run.
    before, after = r"(?iu)(?:^|[\x20\x09-\x0D])[^\x20\x09-\x0D\p{L}\p{N}]*+(?:", r")(?![^\x20\x09-\x0D]*[\p{L}\p{N}])"
    texts = keyed.join(hits, "text_key").withColumn("pattern", F.concat(F.lit(before), F.array_join(literal, "|"), F.lit(after)))
    texts = texts.withColumn("base", base_spans(F.col("text")))

    def itself(match: Column) -> Column:
        """The term of a match, without what stands before it."""
        term = F.regexp_extract(match["value"], r"(?s)[\p{L}\p{N}].*", 0)
        return F.struct((match["end"] - F.length(term)).alias("start"), match["end"].alias("end"), term.alias("value"))

    free = F.filter(
        F.transform(_matches(F.col("text"), F.col("pattern"), F.lit(0)), itself),
        lambda w: ~F.exists("base", lambda s: (w["start"] < s["end"]) & (s["start"] < w["end"])),
    )
    spans = F.transform(free, lambda w: _span(w, len(KINDS), "term")).cast(_SPANS)
    placed = texts.select("text_key", spans.alias("terms")).where(F.size("terms") > 0)
    return placed.groupBy("text_key").agg(F.first("terms").alias("terms"))


def personal_data(docs: DataFrame) -> DataFrame:
    """Counts, digest and list of the spans of every document."""
    found = stage(found_spans(docs), "spans")
    terms = stage(term_spans(docs, stage(revealing_terms(docs, found), "terms")), "term_spans")
    joined = found.join(terms, "text_key", "left").withColumn("all", F.sort_array(F.concat("base", F.coalesce("terms", F.array().cast(_SPANS)))))
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    counts = [F.size(F.array_remove(F.col("base.kind"), kind)) for kind in KINDS]
    counts = [(F.size("base") - rest).cast("long").alias(f"n_{kind}") for kind, rest in zip(KINDS, counts)]
    return joined.select(
        "doc_id", *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("all").alias("spans"),
        F.size(F.coalesce("terms", F.array().cast(_SPANS))).cast("long").alias("n_term"),
    )


def redact(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its label; overlapping spans share the first one's."""
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        label = F.element_at(F.create_map(*(F.lit(x) for kv in LABELS.items() for x in kv)), s["kind"])
        kept = text.substr(state["at"] + 1, s["start"] - state["at"])
        return F.struct(
            F.greatest(state["at"], s["end"]).alias("at"),
            F.when(s["start"] >= state["at"], F.concat(state["out"], kept, label)).otherwise(state["out"]).alias("out"),
        )

    done = F.aggregate(spans, begin, step, lambda s: F.concat(s["out"], text.substr(s["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def sanitised(docs: DataFrame) -> DataFrame:
    """``docs`` with labels in place of base spans and of terms that reveal them. ``n_chars`` follows the text."""
    found = stage(found_spans(docs), "spans")
    terms = term_spans(docs, stage(revealing_terms(docs, found), "terms"))
    key, spans = free_name(docs, "text_key"), free_name(docs, "spans")
    terms = stage(terms.select(F.col("text_key").alias(key), F.col("terms").alias(spans)), "term_spans")
    if _bounded(terms, f"{spans}.value"):
        terms = F.broadcast(terms)
    base = base_spans(text_or_empty())
    marked = docs.withColumn(key, text_key()).join(terms, key, "left")
    marked = marked.withColumn(spans, F.sort_array(F.concat(base, F.coalesce(spans, F.array().cast(_SPANS)))))
    out = marked.withColumn("text", F.when(F.col("text").isNotNull(), redact(F.col("text"), F.col(spans))))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
