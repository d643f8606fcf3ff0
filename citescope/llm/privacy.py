"""Personal data: base patterns and information-theoretic sanitisation; DataFrame functions only.

Base spans are the matches of four patterns (email, ip, card, phone), checked after matching.
The method adds terms that disclose them. A term is a run of letters, without case; its
contexts are the ``WINDOW`` terms on either side of a base span. For a kind of entity c and a
term t, counted over the whole corpus,

    disclosure(c; t) = PMI(c; t) / -log p(c)
                     = 1 - log p(c | t) / log p(c)

where p(c | t) is the share of t's occurrences that stand next to an entity of kind c and p(c)
the share of all terms that do. It is 0 for a term that tells nothing about c and 1 for one that
stands nowhere else. Terms of at least ``THRESHOLD`` that were seen next to at least
``MIN_ENTITIES`` different entities of the kind (copies of one text show one) disclose the kind.

The same is estimated for every single entity e (a kind and a value, such as one e-mail), over
distinct texts, so that copies count once: p(e | t) is the share of the texts with t in which t
stands next to e, p(e) the share of all texts that have e next to a term. A term of at least
``THRESHOLD`` that stands next to e in at least ``MIN_TEXTS`` texts and in as many different
contexts (near copies of a text share theirs) discloses e, and is added under e's kind. Every occurrence of an added term in every text is a span. ``sanitise``
generalises base spans to their kind and removes disclosing terms.

Positions are code points. Patterns are written without backtracking over long runs: atoms
are possessive and a run is entered at its start only, which matches the same spans.

Defined cases: null text is the empty text; spans of one kind never overlap, those of different
kinds may; repeated rows are judged alike, one by one; a null ``doc_id`` is kept; an empty
table gives no rows; other columns are ignored (``find``) or pass through, with ``n_chars``
brought up to date (``sanitise``); texts are read whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citescope.llm.joins import broadcast_if_small
from citescope.session import scratch_path

KINDS = ("email", "ip", "card", "phone")
LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    # shorter runs of digits cannot be cards, so only runs of 14 digits and more are matched
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
TERM = r"\p{L}++"
WINDOW = 3
BLOCK = 256          # matches whose positions are summed at a time
MIN_ENTITIES = 5
MIN_TEXTS = 2        # distinct texts; one alone cannot tell a term from its neighbours
THRESHOLD = 0.9
LABELS = {kind: f"[{kind.upper()}]" for kind in KINDS}

SPAN = "struct<start:int,end:int,value:string>"


def _running(pairs: Column) -> Column:
    """(at, out) of (gap, value) pairs: the length of all, and (start, end, value) of each value."""
    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        end = start + F.length(x["value"])
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(F.struct(
            start.alias("start"), end.alias("end"), x["value"].alias("value")))).alias("out"))

    return F.aggregate(pairs, F.struct(F.lit(0).alias("at"),
                                       F.array().cast(f"array<{SPAN}>").alias("out")), step)


def _positions(text: Column, pattern: str) -> Column:
    """array of (start, end, value) of the matches of a pattern: the pieces between matches
    and the matches themselves give the positions. Running sums copy what they have, so they are
    taken within blocks and over blocks, which keeps texts with very many matches cheap."""
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), 1, F.size(values))
    pairs = F.zip_with(gaps, values, lambda g, v: F.struct(F.length(g).alias("gap"), v.alias("value")))

    def in_blocks(p: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(p), F.lit(BLOCK))
        return F.transform(starts, lambda i: _running(F.slice(p, i, BLOCK)))

    def shifted(blocks: Column) -> Column:
        offsets = F.aggregate(
            blocks, F.array(F.lit(0)),
            lambda found, b: F.concat(found, F.array(F.element_at(found, -1) + b["at"])))
        moved = F.zip_with(blocks, F.slice(offsets, 1, F.size(blocks)), lambda b, by: F.transform(
            b["out"], lambda x: F.struct((x["start"] + by).alias("start"),
                                         (x["end"] + by).alias("end"), x["value"].alias("value"))))
        return F.flatten(moved)

    # one-element arrays: what a lambda is given is evaluated once
    found = F.element_at(F.transform(F.transform(F.array(pairs), in_blocks), shifted), 1)
    return F.when(F.size(values) > 0, found).otherwise(F.array().cast(f"array<{SPAN}>"))


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.call_function("substring", digits, -i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid_card(value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)


VALID: dict[str, Callable[[Column], Column]] = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: v.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"),
    "card": _valid_card,
    "phone": lambda v: F.length(F.regexp_replace(v, "[^0-9]", "")).between(10, 15),
}
# Cheap conditions without which a pattern cannot match.
POSSIBLE: dict[str, Callable[[Column], Column]] = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]"),
    "phone": lambda t: t.contains("+"),
}


def base_spans(text: Column) -> Column:
    """array of (start, kind number, end, value), sorted: all base spans of a text."""
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    found = []
    for kind in KINDS:
        found.append(F.when(POSSIBLE[kind](text), _spans_of(text, kind)).otherwise(empty))
    return F.sort_array(F.concat(*found))


def _spans_of(text: Column, kind: str) -> Column:
    spans = F.filter(_positions(text, PATTERNS[kind]), lambda x: VALID[kind](x["value"]))
    return F.transform(spans, lambda x: F.struct(
        x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"),
        x["end"].alias("end"), x["value"].alias("value")))


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and mark; (doc_id, mark) tells texts apart whatever the rows' order."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")
                       ).withColumn("mark", F.xxhash64("text"))


def _terms_before(terms: Column, at: Column) -> Column:
    """How many of the sorted ``terms`` start before ``at``, by bisection: a context costs the
    same wherever its terms stand."""
    def step(state: Column, _: Column) -> Column:
        middle = F.shiftright(state["low"] + state["high"], 1)
        less = (state["low"] < state["high"]) & (F.get(terms, middle)["start"] < at)
        return F.struct(F.when(less, middle + 1).otherwise(state["low"]).alias("low"),
                        F.when(less, state["high"]).otherwise(middle).alias("high"))

    rounds = F.sequence(F.lit(0), F.length(F.bin(F.size(terms).cast("long"))))
    return F.aggregate(rounds, F.struct(F.lit(0).alias("low"), F.size(terms).alias("high")), step,
                       lambda state: state["low"])


def _context(terms: Column, span: Column) -> Column:
    """(kind, value, term, term_start) of the terms next to a span, cut at its ends."""
    def cut(x: Column, start: Column, end: Column) -> Column:
        value = F.call_function("substring", x["value"], start - x["start"] + 1, end - start)
        return F.struct(span["kind"].alias("kind"), span["value"].alias("value"),
                        F.lower(value).alias("term"), start.alias("term_start"))

    def sides(found: Column) -> Column:
        before, inside = found["before"], found["inside"]
        first = F.greatest(F.lit(0), before - WINDOW)
        left = F.transform(F.slice(terms, first + 1, before - first), lambda x: cut(
            x, x["start"], F.least(x["end"], span["start"])))
        # the last term that starts before the end may go on behind it
        later = F.filter(F.slice(terms, F.greatest(F.lit(1), inside), F.lit(WINDOW + 1)),
                         lambda x: x["end"] > span["end"])
        right = F.transform(F.slice(later, 1, WINDOW), lambda x: cut(
            x, F.greatest(x["start"], span["end"]), x["end"]))
        return F.concat(left, right)

    # one-element arrays: what a lambda is given is evaluated once
    return F.element_at(F.transform(F.array(F.struct(
        _terms_before(terms, span["start"]).alias("before"),
        _terms_before(terms, span["end"]).alias("inside"))), sides), 1)


def contexts(docs: DataFrame) -> DataFrame:
    """doc_id, mark, kind, value, term, term_start, context: the terms next to base spans, with a
    hash of all terms next to the span."""
    spans = (_keyed(docs).withColumn("spans", base_spans(F.col("text")))
             .where(F.size("spans") > 0)
             .select("doc_id", "mark", "spans", _positions(F.col("text"), TERM).alias("terms")))
    def hashed(found: Column) -> Column:
        context = F.xxhash64(F.transform(found, lambda x: x["term"]))
        return F.transform(found, lambda x: F.struct(
            *(x[c].alias(c) for c in ("kind", "value", "term", "term_start")),
            context.alias("context")))

    near = F.flatten(F.transform(
        F.transform("spans", lambda span: _context(F.col("terms"), span)), hashed))
    return spans.select("doc_id", "mark", F.inline(near))


def _counted(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Of each known term its occurrences ``n`` and the number of distinct ``texts`` it is in.

    A text that the corpus holds c times counts 1/c in each copy, so that only sums by term are
    exchanged; the sums are whole numbers but for rounding. Copies are counted on hashes, and
    only texts that have some are looked up."""
    spark = docs.sparkSession
    path = scratch_path(spark, "copies")
    (_keyed(docs).groupBy("mark").agg(F.count("*").alias("copies")).where("copies > 1")
     .write.parquet(path))
    copies = spark.read.schema("mark long, copies long").parquet(path)
    words = F.array_sort(F.transform(F.regexp_extract_all(F.col("text"), F.lit(TERM), F.lit(0)), F.lower))
    rows = (_keyed(docs).join(broadcast_if_small(copies, 16), "mark", "left")
            .select(F.coalesce("copies", F.lit(1)).alias("copies"), F.inline(F.array(F.struct(
                words.alias("words"))))))
    # Sorted, so that the first of equal words is the one behind another word.
    each = rows.select("copies", F.inline(F.transform("words", lambda w, i: F.struct(
        w.alias("term"), ((i == 0) | (F.get("words", i - 1) != w)).alias("first")))))
    return (each.join(known, "term", "left_semi").groupBy("term")
            .agg(F.count("*").alias("n"),
                 F.round(F.sum(F.when(F.col("first"), 1 / F.col("copies")).otherwise(0.0)))
                 .cast("long").alias("texts")))


def disclosing(docs: DataFrame, near: DataFrame, min_entities: int = MIN_ENTITIES,
               threshold: float = THRESHOLD, min_texts: int = MIN_TEXTS) -> DataFrame:
    """kind, term: the terms whose disclosure of a kind, or of one entity, reaches the threshold."""
    spark = docs.sparkSession
    path, entities_path = scratch_path(spark, "candidates"), scratch_path(spark, "entities")
    # a position next to two entities of a kind counts once; so does each copy's position
    places = near.groupBy("kind", "term", "doc_id", "mark", "term_start").agg(
        F.count("*").alias("rows"))
    joint = (places.groupBy("kind", "term").agg(F.count("*").alias("joint"))
             .join(near.groupBy("kind", "term", "value").count().groupBy("kind", "term")
                   .agg(F.count("*").alias("entities")), ["kind", "term"]))
    joint.write.parquet(path)
    joint = spark.read.schema("kind int, term string, joint long, entities long").parquet(path)
    candidates = joint.where(F.col("entities") >= min_entities)
    (near.groupBy("kind", "value", "term")
     .agg(F.count_distinct("mark").alias("together"), F.count_distinct("context").alias("contexts"))
     .where((F.col("together") >= min_texts) & (F.col("contexts") >= min_texts))
     .drop("contexts").write.parquet(entities_path))
    pairs = spark.read.schema("kind int, value string, term string, together long").parquet(entities_path)
    counted_path = scratch_path(spark, "counted")
    terms = candidates.select("term").union(pairs.select("term")).distinct()
    counted = _counted(docs, broadcast_if_small(terms, 64))
    counted.write.parquet(counted_path)
    counted = spark.read.schema("term string, n long, texts long").parquet(counted_path)
    totals = _keyed(docs).agg(F.sum(F.size(F.regexp_extract_all(
        F.col("text"), F.lit(TERM), F.lit(0)))).alias("all"))
    by_kind = joint.groupBy("kind").agg(F.sum("joint").alias("of_kind"))
    scored = (candidates.join(counted, "term").join(by_kind, "kind")
              .withColumn("disclosure", 1 - F.try_divide(
                  F.log(F.least(F.lit(1.0), F.col("joint") / F.col("n"))),
                  F.log(F.col("of_kind") / totals.scalar()))))  # null where all terms stand next to c
    texts = _keyed(docs).select("mark").distinct().agg(F.count("*").alias("all"))
    by_entity = (near.select("kind", "value", "mark").distinct().groupBy("kind", "value")
                 .agg(F.count("*").alias("of_entity")))
    one = (pairs.join(counted, "term").join(by_entity, ["kind", "value"])
           .withColumn("disclosure", 1 - F.try_divide(
               F.log(F.least(F.lit(1.0), F.col("together") / F.col("texts"))),
               F.log(F.col("of_entity") / texts.scalar()))))  # null where all texts have e
    return (scored.select("kind", "term", "disclosure").union(one.select("kind", "term", "disclosure"))
            .where(F.col("disclosure") >= threshold).select("kind", "term").distinct())


def added_spans(docs: DataFrame, **options) -> DataFrame:
    """doc_id, mark, added: array of (start, kind number, end) of the disclosing terms, wherever
    they stand."""
    spark = docs.sparkSession
    path = scratch_path(spark, "contexts")
    near = contexts(docs)
    near.write.parquet(path)
    near = spark.read.schema(near.schema).parquet(path)
    found_path = scratch_path(spark, "disclosing")
    disclosing(docs, near, **options).write.parquet(found_path)
    found = spark.read.schema("kind int, term string").parquet(found_path)
    terms = found.groupBy("term").agg(F.sort_array(F.collect_set("kind")).alias("kinds"))
    out_path = scratch_path(spark, "added")
    words = _keyed(docs).select("doc_id", "mark", F.explode(F.array_distinct(F.regexp_extract_all(
        F.col("text"), F.lit(TERM), F.lit(0)))).alias("word"))
    # which words of a text are disclosing terms: at most its distinct words
    own = (words.withColumn("term", F.lower("word")).join(broadcast_if_small(terms, 64), "term")
           .groupBy(F.col("doc_id").alias("own_id"), F.col("mark").alias("own_mark"))
           .agg(F.map_from_entries(F.collect_set(F.struct("word", "kinds"))).alias("kinds_of")))
    own_path = scratch_path(spark, "own-terms")
    own.write.parquet(own_path)
    own = spark.read.schema("own_id long, own_mark long, kinds_of map<string,array<int>>").parquet(own_path)
    hit = (_keyed(docs).join(broadcast_if_small(own, 256), F.col("doc_id").eqNullSafe(F.col("own_id"))
                      & (F.col("mark") == F.col("own_mark"))))
    spans = F.flatten(F.transform(
        F.filter(_positions(F.col("text"), TERM), lambda x: F.map_contains_key("kinds_of", x["value"])),
        lambda x: F.transform(F.element_at("kinds_of", x["value"]), lambda kind: F.struct(
            x["start"].alias("start"), kind.alias("kind"), x["end"].alias("end")))))
    (hit.select(F.col("doc_id").alias("added_id"), F.col("mark").alias("added_mark"),
                spans.alias("added")).groupBy("added_id", "added_mark")
     .agg(F.first("added").alias("added")).write.parquet(out_path))
    return spark.read.schema("added_id long, added_mark long, "
                             "added array<struct<start:int,kind:int,end:int>>").parquet(out_path)


def _with_spans(docs: DataFrame, keyed: DataFrame, **options) -> DataFrame:
    """``keyed`` (text, doc_id, mark, ...) with the columns base and added."""
    added = added_spans(docs, **options)
    return (keyed.withColumn("base", base_spans(F.col("text")))
            .join(broadcast_if_small(added, 64),
                  F.col("doc_id").eqNullSafe(F.col("added_id"))
                  & (F.col("mark") == F.col("added_mark")), "left")
            .drop("added_id", "added_mark"))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS], *[F.lit(f"{k}_term") for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")


def _plain(spans: Column, shift: int = 0) -> Column:
    return F.transform(spans, lambda x: F.struct(
        x["start"].alias("start"), (x["kind"] + shift).alias("kind"), x["end"].alias("end")))


def _all(base: Column, added: Column) -> Column:
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return F.sort_array(F.concat(_plain(base), F.coalesce(_plain(added, len(KINDS)), none)))


def _count(kind: int) -> Column:
    return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")


def find(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_<kind> of each kind, base (joined base spans), spans (all spans, joined)."""
    rows = _with_spans(docs, _keyed(docs), **options)
    return rows.select(
        "doc_id", *[_count(n).alias(f"n_{kind}") for n, kind in enumerate(KINDS)],
        _joined(_plain(F.col("base"))).alias("base"),
        _joined(_all(F.col("base"), F.col("added"))).alias("spans"))


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with base spans replaced by their kind and disclosing terms removed; all columns,
    ``n_chars`` (if there) counted anew. Overlapping spans go as one, under the first's name."""
    label = F.array(*[F.lit(LABELS[k]) for k in KINDS], *[F.lit("") for _ in KINDS])
    own = F.col("document.text").cast("string")
    keyed = docs.select(F.struct("*").alias("document")).select(
        "document", F.coalesce(own, F.lit("")).alias("text"),
        F.col("document.doc_id").cast("long").alias("doc_id")).withColumn("mark", F.xxhash64("text"))
    rows = _with_spans(docs, keyed, **options).withColumn(
        "all_spans", _all(F.col("base"), F.col("added")))

    def step(state: Column, x: Column) -> Column:
        fresh = x["start"] >= state["at"]
        between = F.call_function("substring", F.col("text"), state["at"] + 1,
                                  x["start"] - state["at"])
        return F.struct(
            F.greatest(state["at"], x["end"]).alias("at"),
            F.when(fresh, F.concat(state["out"], F.array(
                between, F.element_at(label, x["kind"] + 1)))).otherwise(state["out"]).alias("out"))

    clean = F.aggregate(
        "all_spans", F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        step, lambda s: F.concat(F.array_join(s["out"], ""), F.call_function(
            "substring", F.col("text"), s["at"] + 1, F.length("text"))))
    text = F.when(F.size("all_spans") > 0, clean).otherwise(own)
    rows = rows.withColumn("clean", text)
    columns = {"text": F.col("clean"), "n_chars": F.when(
        F.size("all_spans") > 0, F.length("clean").cast("long")).otherwise(
        F.col("document.n_chars"))} if "n_chars" in docs.columns else {"text": F.col("clean")}
    return rows.select(*[(columns[c] if c in columns else F.col("document")[c])
                         .cast(docs.schema[c].dataType).alias(c) for c in docs.columns])
