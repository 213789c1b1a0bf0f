"""Personal data: spans by rule, and terms that disclose them by corpus co-occurrence (native).

Emails, addresses, card and phone numbers are found by pattern.  Protected entities are the values and what
they have in common: mail domain and name, networks, card issuer, phone prefix.  A term discloses an entity as
far as knowing the term removes the entity's information content ``IC(e) = -log2 p(e)``: the share is
``PMI(e, t) / IC(e)``, 1 if the term is never seen without the entity.  Probabilities are document counts over
the whole corpus.  As few texts prove little, ``p(e | t)`` enters with the lower end of its Wilson interval of
``z`` standard errors.  Where a document holds the entity, its terms whose lower share reaches ``generalise``
are to be replaced by their kind, or taken out if their plain share reaches ``remove``.

Only entities in two different texts can be learned from, so counting pairs is limited to documents
with such an entity and to terms rare enough to reach the threshold with it; term frequencies are
pre-aggregated map-side over all words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sightline.llm.common import lower_ascii, saved, small_side

#: Kinds in their order, each with its pattern.  A match can begin only where a run of its first class does or
#: where the last match ended, and runs are possessive: the matches of the plain patterns, without retrying
#: every position of a long run.
_LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = (*PATTERNS, "term")
#: What a text needs to have a match at all.
_NEEDS = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: F.rlike(t, F.lit(r"[0-9]\.[0-9]")),
    "card": lambda t: F.rlike(t, F.lit(r"[0-9](?:[\x20-]?[0-9]){15}")),
    "phone": lambda t: F.contains(t, F.lit("+")),
}
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
MIN_TEXTS, GENERALISE, REMOVE, Z = 2, 0.90, 0.99, 1.0


def _pieces(text: Column, pattern: str) -> tuple[Column, Column]:
    """Matches, and the lengths of the gaps before each and after the last."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.transform(F.split(text, pattern, -1), F.length)


def _located(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows ``*by, matches, gaps`` to one row per match: ``*by, i, value, start, end`` in code points."""
    each = rows.select(*by, F.posexplode(F.arrays_zip(F.col("matches").alias("m"), F.slice("gaps", F.lit(1), F.size("matches")).alias("g"))).alias("i", "x"))
    each = each.select(*by, "i", F.col("x.m").alias("value"), (F.col("x.g") + F.length("x.m")).alias("step"))
    upto = Window.partitionBy(*by).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)  # within one text
    return each.withColumn("end", F.sum("step").over(upto).cast("int")).withColumn("start", F.col("end") - F.length("value")).drop("step")


def _luhn(digits: Column) -> Column:
    turned = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(turned, i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def rule_spans(texts: DataFrame) -> DataFrame:
    """Spans by rule of ``texts`` (``_text, text``): one row ``_text, rows, kind, value, start, end``.

    ``_text`` identifies a text; equal texts are looked at together and ``rows`` is how many there are.
    """
    kinds = list(PATTERNS)
    found = texts.select("_text", "text", *[F.when(_NEEDS[k](F.col("text")), _pieces(F.col("text"), PATTERNS[k])[0]).alias(k) for k in kinds])
    some = found.filter(" or ".join(f"size({k}) > 0" for k in kinds))
    parts = [F.when(F.size(k) > 0, F.struct(F.lit(k).alias("kind"), F.col(k).alias("matches"), _pieces(F.col("text"), PATTERNS[k])[1].alias("gaps"))) for k in kinds]
    once = some.select("_text", F.filter(F.array(*parts), lambda x: x.isNotNull()).alias("parts"))
    once = once.groupBy("_text").agg(F.count("*").alias("rows"), F.first("parts").alias("parts"))
    per_kind = once.select("_text", "rows", F.explode("parts").alias("p")).select("_text", "rows", "p.*")
    each = _located(per_kind, ["_text", "rows", "kind"])
    digits = F.regexp_replace("value", "[^0-9]", "")
    n = F.length(digits)
    parts_ok = F.forall(F.split("value", r"\."), lambda p: F.rlike(p, F.lit("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")))
    holds = (
        F.when(F.col("kind") == "email", F.lit(True))
        .when(F.col("kind") == "ip", parts_ok)
        .when(F.col("kind") == "card", F.when(n.between(16, 19), _luhn(digits)).otherwise(False))
        .otherwise(n.between(8, 15))
    )
    return each.filter(holds).drop("i")


def entities(kind: Column, value: Column) -> Column:
    """What a span protects, from the value to coarser levels: an array of strings, empty ones left out."""
    plain, digits = lower_ascii(value), F.regexp_replace(value, "[^0-9]", "")
    local, domain = F.split_part(plain, F.lit("@"), F.lit(1)), F.split_part(plain, F.lit("@"), F.lit(2))
    parts = F.split(plain, r"\.")
    net = lambda n: F.array_join(F.slice(parts, 1, n), ".")
    levels = (
        F.when(kind == "email", F.array(plain, domain, F.regexp_extract(local, "^[a-z]+", 0)))
        .when(kind == "ip", F.array(plain, net(3), net(2)))
        .when(kind == "card", F.array(digits, F.substring(digits, 1, 6)))
        .otherwise(F.array(digits, F.left(digits, F.length(digits) - 4)))
    )
    named = F.transform(levels, lambda x, i: F.when(x != "", F.concat_ws(":", kind, i.cast("string"), x)))
    return F.filter(named, lambda x: x.isNotNull())


def _lower(p: Column, n: Column, z: float) -> Column:
    """Lower end of the Wilson interval of a share ``p`` among ``n``."""
    return (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def disclosing_terms(texts: DataFrame, spans: DataFrame, min_texts: int = MIN_TEXTS, share: float = GENERALISE, z: float = Z) -> DataFrame:
    """Terms ``_text, term, share`` that disclose an entity of their own text; ``share`` is the highest plain one.

    ``texts`` are all documents, ``spans`` the spans by rule.  An entity, and a term with it, must be in
    ``min_texts`` different texts, so that exact copies alone prove nothing; the interval counts different
    texts too: those with both, and as many more as the term's rows outnumber the rows with both.
    """
    held = spans.select("_text", "rows", F.explode(entities(F.col("kind"), F.col("value"))).alias("entity"))
    held = held.select("_text", "rows", F.xxhash64("entity").alias("entity")).distinct()
    several = held.groupBy("entity").agg(F.count("*").alias("texts"), F.sum("rows").alias("with_e")).filter(F.col("texts") >= min_texts)
    held = saved(held.join(several.select("entity", "with_e"), "entity"))

    words = F.array_distinct(F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(TERM), F.lit(0)))
    df = texts.select(F.explode(words).alias("term")).groupBy("term").agg(F.count("*").alias("with_t"))
    here = held.groupBy("_text").agg(F.max("with_e").alias("most"))
    own = texts.join(small_side(here), "_text").select("_text", "most", F.explode(words).alias("term")).distinct()
    n = texts.count()
    # co <= with_e, so the share can be reached only by terms up to this frequency
    rare = F.col("with_t") <= F.col("most") * F.pow(n / F.col("most"), F.lit(1 - share)) + 1e-9
    own = saved(own.join(df, "term").filter(rare & (F.col("with_t") >= min_texts)).select("_text", "term", "with_t"))

    met = own.join(held, "_text")
    both = met.groupBy("entity", "term").agg(
        F.count("*").alias("texts"), F.sum("rows").alias("co"), F.first("with_t").alias("with_t"), F.first("with_e").alias("with_e")
    )
    both = both.filter(F.col("texts") >= min_texts)
    info, p = F.log2(n / F.col("with_e")), F.col("co") / F.col("with_t")
    # log2(p(e|t) / p(e)) / IC(e); an entity in every document has no information to disclose
    of = lambda chance: F.when(info > 0, 1 + F.log2(chance) / info).otherwise(0.0)
    both = both.withColumn("share", of(p)).filter(of(_lower(p, F.col("texts") / p, z)) >= share - 1e-9)
    pairs = saved(both.select("entity", "term", "share"))
    return met.select("_text", "entity", "term").join(pairs, ["entity", "term"]).groupBy("_text", "term").agg(F.max("share").alias("share"))


def personal_spans(docs: DataFrame, min_texts: int = MIN_TEXTS, generalise: float = GENERALISE, remove: float = REMOVE, z: float = Z) -> DataFrame:
    """All spans of each row of ``docs`` (``doc_id, text``): ``doc_id, _text, spans``.

    ``spans`` is an array of ``kind, start, end, action`` by kind as in KINDS, then start; offsets are code
    points, end exclusive.  Spans by rule are generalised; ``term`` spans lie outside of them.  Null texts are
    empty; equal texts have equal spans, repeated ids or not; no document, no row.  Texts and entities are
    told apart by 64-bit hashes: the chance of any mistake among N of them is below N^2 / 2^65.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_text", F.xxhash64("text"))
    found = saved(rule_spans(texts.select("_text", "text")))
    terms = saved(disclosing_terms(texts.select("_text", "text"), found, min_texts, generalise, z))

    flagged = texts.select("_text", "text").join(small_side(terms.select("_text").distinct()), "_text")
    matches, gaps = _pieces(F.col("text"), TERM)
    flagged = flagged.select("_text", matches.alias("matches"), gaps.alias("gaps")).dropDuplicates(["_text"])
    where = _located(flagged, ["_text"]).withColumn("term", lower_ascii(F.col("value"))).join(terms, ["_text", "term"])
    where = where.select("_text", "start", "end", F.when(F.col("share") >= remove - 1e-9, "remove").otherwise("generalise").alias("action"))
    ruled = found.select("_text", F.col("start").alias("s"), F.col("end").alias("e"))
    clash = (where["_text"] == ruled["_text"]) & (F.col("start") < F.col("e")) & (F.col("s") < F.col("end"))
    where = where.join(ruled, clash, "left_anti").withColumn("kind", F.lit("term"))

    every = found.select("_text", "kind", "start", "end", F.lit("generalise").alias("action")).unionByName(where.select("_text", "kind", "start", "end", "action"))
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    listed = every.groupBy("_text").agg(F.array_sort(F.collect_list(F.struct(order.alias("order"), "start", "end", "kind", "action"))).alias("spans"))
    listed = listed.select("_text", F.transform("spans", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["action"].alias("action"))).alias("spans"))
    listed = saved(listed)  # a join with a written table is split where one text has very many copies
    none = F.array().cast("array<struct<kind: string, start: int, end: int, action: string>>")
    return texts.select("doc_id", "_text").join(listed, "_text", "left").withColumn("spans", F.coalesce("spans", none))


def sanitised(text: Column, spans: Column) -> Column:
    """The text with spans replaced by ``[KIND]``, removed terms by nothing; overlapping spans count once, the earliest first."""
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), x["action"].alias("action"))))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, x: Column) -> Column:
        mark = F.when(x["action"] == "remove", "").otherwise(F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")))
        ahead = F.substring(text, state["at"] + 1, x["start"] - state["at"])
        longer = F.struct(x["end"].alias("at"), F.concat(state["out"], ahead, mark).alias("out"))
        return F.when(x["start"] >= state["at"], longer).otherwise(F.struct(F.greatest(state["at"], x["end"]).alias("at"), state["out"].alias("out")))

    done = F.aggregate(ordered, zero, step)
    return F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))
