"""Personal data: fixed patterns, and terms that give protected entities away.

Patterns find e-mail addresses, IP addresses, card numbers and phone numbers. The values found are
the protected entities. How much a word of the same document discloses is estimated from the corpus:
PMI(term; entity) = log2(p(term | entity) / p(term)), with p(term) = has(term) / N from document
counts and p(term | entity) from the entity's different contexts, smoothed so that little evidence
counts less but nothing is left out. The entity itself carries IC(entity) = log2(N / has(entity)).
A term whose PMI reaches a share of the IC tells nearly as much as the entity: it is generalised, or
removed where it leaves at most a few bits of the IC open.

Everything is built from SQL functions. The patterns are stated with single-character classes only,
after marking the separators inside numbers and domains, because nested groups would recurse once
per repetition and overflow on very long runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronage.session import settle

KINDS = ("email", "ip", "card", "phone", "term")
# Stand-ins for a separator between two digits and a dot between two domain characters, and what
# those two characters become if a text has them.
_JOIN, _DOT, _OTHER = "\ue000", "\ue001", "\ue002"
EMAIL = (rf"(?:\G|(?<![A-Za-z0-9._%+{_DOT}-]))[A-Za-z0-9._%+{_DOT}-]++@[A-Za-z0-9-]++{_DOT}"
         rf"[A-Za-z0-9{_DOT}-]++")
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = rf"[0-9{_JOIN}]{{2,}}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BLOCK_WORDS = 128
_SPAN = "struct<start:bigint,kind:int,end:bigint,value:string>"


def _matches(text: Column, pattern: str, kind: int, possible: Column) -> Column:
    """All matches with their positions, from the matches and the gaps between them."""
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    none = F.array().cast(f"array<{_SPAN}>")

    def step(state: Column, i: Column) -> Column:
        start = state["at"] + F.length(F.get(gaps, i))
        end = start + F.length(F.get(values, i))
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"),
                        F.get(values, i).alias("value"))
        return F.struct(end.alias("at"), F.array_append(state["out"], span).alias("out"))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("out"))
    walked = F.aggregate(F.sequence(F.lit(0), F.size(values) - 1), start,
                         lambda s, i: step(s, i).cast(f"struct<at:bigint,out:array<{_SPAN}>>"),
                         lambda s: s["out"])
    return F.when(possible & (F.size(values) > 0), walked).otherwise(none)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def passes_luhn(digits: Column) -> Column:
    back = F.split(F.reverse(digits), "")

    def add(total: Column, i: Column) -> Column:
        digit = F.ascii(F.get(back, i)) - 48
        twice = F.when(digit > 4, 2 * digit - 9).otherwise(2 * digit)
        return total + F.when(i % 2 == 1, twice).otherwise(digit)

    total = F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add)
    return total % 10 == 0


def _valid_ip(value: Column) -> Column:
    def small(part: Column) -> Column:
        bare = F.ltrim(part, F.lit("0"))
        return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= "255"))
    return F.forall(F.split(value, r"\."), small)


def pattern_spans(text: Column) -> Column:
    """All valid spans of a text, ordered by start and kind; positions in code points."""
    clean = F.when(text.rlike(f"[{_JOIN}{_DOT}]"),
                   F.translate(text, _JOIN + _DOT, _OTHER + _OTHER)).otherwise(text)
    at_sign, digit = F.contains(text, F.lit("@")), text.rlike("[0-9]")
    dotted = F.when(at_sign, F.regexp_replace(
        clean, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", _DOT)).otherwise(F.lit(""))
    joined = F.when(digit, F.regexp_replace(
        clean, r"(?<=[0-9])[\x20-](?=[0-9])", _JOIN)).otherwise(F.lit(""))
    numeric = F.when(digit, text).otherwise(F.lit(""))
    emails = _matches(dotted, EMAIL, 0, at_sign)
    ips = F.filter(_matches(numeric, IP, 1, digit), lambda s: _valid_ip(s["value"]))
    cards = F.filter(_matches(joined, CARD, 2, digit), lambda s: F.when(
        F.length(_digits(s["value"])).between(12, 19), passes_luhn(_digits(s["value"])))
        .otherwise(F.lit(False)))
    phones = F.filter(_matches(numeric, PHONE, 3, digit & F.contains(text, F.lit("+"))),
                      lambda s: F.length(_digits(s["value"])).between(9, 15))
    return F.array_sort(F.concat(emails, ips, cards, phones))


def entity(span: Column) -> Column:
    """What a span protects: its kind and its value without differences of writing."""
    value = F.when(span["kind"] == 0, F.lower(F.translate(span["value"], _DOT, "."))) \
        .when(span["kind"] == 1, span["value"]).otherwise(_digits(span["value"]))
    return F.concat(span["kind"].cast("string"), F.lit(":"), value)


_WORD = r"[\p{L}\p{N}]+"


def text_words(text: Column) -> Column:
    """The words of a text with their positions, walked in blocks so that no long list is copied."""
    kind = "array<struct<term:string,start:bigint,end:bigint>>"
    none = F.array().cast(kind)

    def walk(cut: Column) -> Column:
        words, gaps = cut["words"], cut["gaps"]

        def step(state: Column, i: Column) -> Column:
            start = state["at"] + F.length(F.get(gaps, i))
            end = start + F.length(F.get(words, i))
            word = F.struct(F.lower(F.get(words, i)).alias("term"), start.alias("start"),
                            end.alias("end"))
            return F.struct(end.alias("at"), F.array_append(state["out"], word).alias("out")).cast(
                f"struct<at:bigint,out:{kind}>")

        def block(state: Column, first: Column) -> Column:
            last = F.least(first + (BLOCK_WORDS - 1), F.size(words) - 1)
            begin = F.struct(state["at"].alias("at"), none.alias("out"))
            return F.aggregate(F.sequence(first, last), begin, step, lambda s: F.struct(
                s["at"].alias("at"), F.array_append(state["out"], s["out"]).alias("out")).cast(
                f"struct<at:bigint,out:array<{kind}>>"))

        begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<{kind}>")
                         .alias("out"))
        return F.when(F.size(words) > 0, F.aggregate(
            F.sequence(F.lit(0), F.size(words) - 1, F.lit(BLOCK_WORDS)), begin, block,
            lambda s: F.flatten(s["out"]))).otherwise(none)

    # Inside a lambda the cut text is a value, which is computed once.
    cut = F.struct(F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)).alias("words"),
                   F.split(text, _WORD, -1).alias("gaps"))
    return F.get(F.transform(F.array(cut), walk), F.lit(0))


def disclosing_terms(mentions: DataFrame, holders: DataFrame, texts: DataFrame, *,
                     share: float, least_contexts: int = 1, prior: float = 1.0) -> DataFrame:
    """(entity, term, ratio, left) for terms whose PMI with an entity reaches ``share`` of its IC;
    ``left`` is the IC without the PMI, in bits.

    ``mentions`` has (entity, term), a row for every different context of the entity that has the
    term, ``holders`` (rid, entity, context), ``texts`` (text), all documents of the corpus. How often a term comes with an entity is counted over the
    entity's different contexts, so that copies of one text prove nothing, and smoothed with
    ``prior`` contexts in which the term is as frequent as anywhere: (with + prior * p(term)) /
    (contexts + prior). One context costs a term one bit of its PMI, ten cost it an eighth of a bit.
    ``least_contexts`` leaves out terms with fewer contexts. Counts are added up where the words stand before
    they are shuffled.
    """
    entities = (holders.distinct().groupBy("entity")
                .agg(F.countDistinct("rid").alias("has_entity"),
                     F.countDistinct("context").alias("contexts")))
    near = (mentions.groupBy("entity", "term").agg(F.count("*").alias("near"))
            .filter(F.col("near") >= least_contexts))
    vocabulary = (texts.select(F.explode(F.array_distinct(F.regexp_extract_all(
        F.lower("text"), F.lit(_WORD), F.lit(0)))).alias("term"))
        .groupBy("term").agg(F.count("*").alias("has_term")))
    total = texts.agg(F.count("*").cast("double").alias("n")).scalar()
    rated = near.join(entities, "entity").join(vocabulary, "term").withColumn("n", total)
    information = F.log2(F.col("n") / F.col("has_entity"))
    anywhere = F.col("has_term") / F.col("n")
    pmi = F.log2((F.col("near") + prior * anywhere) / (F.col("contexts") + prior) / anywhere)
    return (rated.withColumns({"ratio": F.when(information > 0, pmi / information),
                               "left": information - pmi})
            .filter(F.col("ratio") >= share).select("entity", "term", "ratio", "left"))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _replaced(text: Column, spans: Column, remove_bits: float) -> Column:
    """The text with its spans replaced from left to right; of overlapping ones the first counts."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    kind = "struct<at:bigint,out:string>"

    def step(state: Column, s: Column) -> Column:
        sign = F.when((s["kind"] == 4) & (s["left"] <= remove_bits), F.lit("")) \
            .otherwise(F.get(names, s["kind"]))
        done = F.struct(s["end"].alias("at"), F.concat(
            state["out"], F.substring(text, state["at"] + 1, s["start"] - state["at"]), sign)
            .alias("out")).cast(kind)
        return F.when(s["start"] >= state["at"], done).otherwise(state)

    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out")).cast(kind)
    return F.aggregate(spans, begin, step, lambda s: F.concat(
        s["out"], F.substring(text, s["at"] + 1, F.length(text))))


def sanitise(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
             share: float = 0.8, remove_bits: float = 1.0, least_contexts: int = 1) -> DataFrame:
    """Personal data of every whole text.

    Returns (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, sanitised): counts and
    digest of the pattern spans, all spans as ``kind:start:end`` by start and kind, and the text
    with its spans replaced by their kind, or null if there are none. Terms of kind ``term`` are
    words, runs of letters and digits, that disclose an entity (see ``disclosing_terms``); those that
    leave at most ``remove_bits`` of it open are taken out instead of generalised. With one context
    that are terms that stand nowhere else. All words of a document that holds the entity are counted,
    and marked wherever they stand in it, unless they overlap a pattern span. Documents without
    pattern spans stay as they are.

    A null text is an empty one: no spans, and the digest of the empty string. Rows that repeat an
    id, and rows without one, are treated one by one. An empty table gives an empty result. Other
    columns are not looked at.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"),
                        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    spotted = texts.withColumn("base", pattern_spans(F.col("text")))
    has = F.size("base") > 0
    outside = F.filter(text_words(F.col("text")), lambda w: ~F.exists(
        "base", lambda s: (s["start"] < w["end"]) & (w["start"] < s["end"])))
    found = settle(spotted.select(
        F.monotonically_increasing_id().alias("rid"), "doc_id", "base",
        F.when(has, F.col("text")).alias("text"), F.when(has, outside).alias("words")))
    private = found.filter(F.size("base") > 0)
    held = private.select(
        "rid", F.xxhash64(F.array_join(F.col("words.term"), " ")).alias("context"),
        F.explode(F.array_distinct(F.transform("base", entity))).alias("entity"))
    # Entities of the same documents have the same ratios and are rated as one, so that a document
    # with many entities of its own is not counted once for each.
    alike = held.groupBy("entity").agg(F.xxhash64(
        F.count("*"), F.bit_xor(F.xxhash64("rid")), F.min("rid")).alias("class"))
    holders = settle(held.join(alike, "entity")
                     .select("rid", F.col("class").alias("entity"), "context").distinct())
    once = holders.groupBy("entity", "context").agg(F.min("rid").alias("rid"))
    terms = private.select("rid", F.array_distinct("words.term").alias("terms"))
    mentions = once.join(terms, "rid").select("entity", F.explode("terms").alias("term"))
    telling = disclosing_terms(mentions, holders, texts, share=share, least_contexts=least_contexts)
    rated = (holders.join(telling, "entity").groupBy("rid", "term")
             .agg(F.min("left").alias("left")))
    marked = (private.select("rid", F.explode("words").alias("w")).select("rid", "w.*")
              .join(rated, ["rid", "term"]).groupBy("rid")
              .agg(F.collect_list(F.struct("start", F.lit(4).alias("kind"), "end", "left"))
                   .alias("terms")))
    plain = F.transform("base", lambda s: F.struct(
        s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"),
        F.lit(0.0).alias("left")))
    every = F.array_sort(F.concat(plain, F.coalesce(F.col("terms"), F.array().cast(
        "array<struct<start:bigint,kind:int,end:bigint,left:double>>"))))

    def count(kind: int) -> Column:
        of_kind = F.filter("base", lambda s: s["kind"] == kind)
        return F.size(of_kind).cast("bigint").alias(f"n_{KINDS[kind]}")

    counts = [count(k) for k in range(4)]
    return (found.join(marked, "rid", "left").withColumn("every", every)
            .select("doc_id", *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
                    _listed(F.col("every")).alias("spans"),
                    F.when(F.size("every") > 0, _replaced(F.col("text"), F.col("every"), remove_bits))
                    .alias("sanitised")))
